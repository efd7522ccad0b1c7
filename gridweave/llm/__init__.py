"""Operators for training corpora. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get the functions themselves, so they need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
