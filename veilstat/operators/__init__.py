"""Data-scale operators: DataFrame in, DataFrame or columns out."""
