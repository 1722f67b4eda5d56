"""quarry: a PySpark-native engine for document retrieval, evaluation and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
