"""Spark-first engine for building, checking and scoring paired speech-text data.

Functions sent to executors are pickled by value, so that these need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
