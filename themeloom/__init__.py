"""Trend mining over tables of documents and tables of questions, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so executors need Spark and
# numpy only, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
