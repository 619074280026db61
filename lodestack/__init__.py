"""Lodestack: a PySpark-native engine for document retrieval corpora and their evaluation."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
