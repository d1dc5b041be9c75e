"""Operators for preparing training data: deduplication, filtering, counting and mixing.

Nothing else in the library imports this package, so it can be removed as a whole.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
