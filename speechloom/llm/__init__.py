"""Operators for preparing large text corpora for language-model training.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
Functions sent to executors are pickled by value, so that these need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
