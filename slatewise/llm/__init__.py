"""Operators for training-data pipelines; nothing else in the library imports this package.

Functions of this package travel to the executors with the jobs that use them, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
