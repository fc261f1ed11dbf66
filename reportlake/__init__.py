"""Spark-native extraction of key figures from semi-structured reports."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so a cluster needs no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
