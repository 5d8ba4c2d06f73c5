"""Operators of a training-data pipeline: one module for each, and their queries.

The package is shipped to executors by value, so that a job needs no copy of the library on
the machines that run it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
