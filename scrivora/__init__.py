"""Scrivora: a PySpark-native text retrieval and corpus analytics engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors take this package's code along, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
