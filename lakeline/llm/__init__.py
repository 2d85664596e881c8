"""Operators of a training-data pipeline over tables of documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions go to the tasks by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
