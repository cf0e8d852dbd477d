"""treecut: Penn-Treebank-style tokenisation of large text corpora on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers of this package (Pandas UDFs, grouped maps) are shipped to
# the workers by value, so executors need no copy of the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .functions.tokenize import (  # noqa: F401
    byte_length,
    normalise_marks,
    ptb_line_tokens,
    ptb_text,
    ptb_token_count,
    ptb_tokens,
    token_text,
    tokens,
    whitespace_tokens,
)
from .session import get_session, spread  # noqa: F401
