"""Spark-native usage metering and corpus processing."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
