"""PySpark-native analytics engine for event time series and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of the package that run in Python workers travel with the plan, so
# executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
