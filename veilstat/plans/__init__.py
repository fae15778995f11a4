"""Release specifications, and what follows from released values."""
