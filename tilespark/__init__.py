"""A Spark-native engine for single-file tile archives.

Functions of this package that run in Python workers are pickled by value, so the
executors of a cluster need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
