"""tickloom: a Spark-native engine for bid/ask quote data and the tables around it."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
