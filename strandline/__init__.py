"""Market and macro analytics over (ticker, date) tables, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with their task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
