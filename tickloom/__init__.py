"""Order-flow analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# UDF code travels to executors by value; they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
