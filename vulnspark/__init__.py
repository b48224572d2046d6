"""Labeled code-security corpora and scanner findings as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry this package's code with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
