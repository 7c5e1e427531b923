"""Operators for building training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: nothing need be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
