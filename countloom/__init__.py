"""countloom: count-matrix analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
