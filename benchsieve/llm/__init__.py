"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors get these modules with the tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
