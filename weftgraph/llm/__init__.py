"""Operators for large text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that the
# executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
