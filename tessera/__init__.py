"""Spark-native analytics over research records, and training-data operators.

The package is shipped to executors inside the pickled closures, so that a
worker needs no copy of it on its own path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
