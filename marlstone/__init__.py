"""Marlstone: a PySpark-native engine for event-sourced, time-series research analytics."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
