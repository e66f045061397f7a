"""Operators for training-data pipelines. Their task functions travel by value, so executors need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
