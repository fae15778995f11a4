"""Sentences of errors and warnings that callers match on."""

#: These sentences are part of the interface, word for word; ``{}`` stands for what was passed.
EMPTY = "Input may not be NA or NULL."
N_EMPTY = "Input n may not be NA or NULL."
N_WHOLE = "n must be a positive whole number."
LENGTH = "Input was expected to be of length  {}  but is instead of length  {}"
RANGE_EMPTY = "Input range may not be empty."
RANGE_MISSING = "Input range may not contain NA values."
RANGE_SHORT = "Error in range argument provided, {} : requires upper and lower values as vector of length 2."
RANGE_LONG = "Range argument of {} has more than two values.  Will proceed using min and max values as range."
RANGE_DROPPED = "Range argument provided {} has NA value. Setting range to NULL."
IMPUTE_TYPE = "Imputation range entered for variable that is not of numeric or integer type. Setting imputation range to data range."
IMPUTE_LOW = "Lower bound of imputation range is outside of the data range. Setting lower bound of the imputation range to the lower bound of the data range."
IMPUTE_HIGH = "Upper bound of imputation range is outside of the data range. Setting upper bound of the imputation range to the upper bound of the data range."
EPSILON_POSITIVE = "Privacy parameter epsilon must be a value greater than zero."
DELTA_UNUSED = "A delta parameter has been entered, but a mechanism that uses a delta value is not being used. Setting delta to 0."
DELTA_RISK = "A delta value on the order of 1/n^2 is a privacy risk, as it allows for additional data to leak beyond the privacy parameter epsilon. Choose a smaller value for delta to maintain your privacy guarantee."
VARIABLE_TYPE = "Variable type {} should be one of {}"
BINS_CHARACTER = "Bins must be of type `character` for a variable of type `character`"
BINS_NUMERIC = "Bins must be numeric for a numeric variable"
BINS_LOGICAL = "Histogram bins for a logical variable may only be 0, 1, or NA"
BINS_AND_RANGE = "You have entered both bins and a data range, when you do not need both. Default is to use the bins that have been entered. If you would like to use the range, please enter the range and the desired number of bins and omit the bins."
BINS_UNKNOWN = "number of bins or granularity must be specified"
BINS_FEW = "number of bins must be at least 2"
BINS_WHOLE = "non-integer value for number of bins converted to next highest integer value"
