"""Spark-first engine for curating large media and document collections."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so that the package need not be installed or on the path there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
