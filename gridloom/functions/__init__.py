"""Column functions on arrays and text: the kernels."""

from gridloom.functions.kernels import (  # noqa: F401
    compensated_sum,
    compose,
    dense,
    dot,
    masked_sum,
    mean_stdev,
    mean_stdev_without,
    standard_score,
    zscore_value,
)
from gridloom.functions.text import count_tokens, numeric_prefix, strict_number, tokens, tokens_or_empty, trimmed  # noqa: F401
