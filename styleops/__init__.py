"""Spark-native preparation and evaluation of text style corpora."""

import sys

from pyspark import cloudpickle

# Send the package's helper functions along with the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
