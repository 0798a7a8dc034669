"""Gleaner: document-and-table question answering as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
