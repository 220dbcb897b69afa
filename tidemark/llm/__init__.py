"""Operators for training corpora: quality, deduplication, packing, mixing, filters, personal data, search, archives."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that nothing needs to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
