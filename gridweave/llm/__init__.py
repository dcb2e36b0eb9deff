"""Operators for building large text corpora.

Nothing else in the library imports this subpackage.  Its functions run in
Python workers that may not have the library on their path, so they are
pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
