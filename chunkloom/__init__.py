"""chunkloom: chunked volumes, their indexes and their metadata as Spark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so these need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
