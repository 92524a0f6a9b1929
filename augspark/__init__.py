"""Preparation, augmentation, scoring and evaluation of labelled text on Spark."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with the query, so the package need not be installed
# on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
