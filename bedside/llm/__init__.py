"""Operators for training-data pipelines over document, page and vector tables.

Functions that run in Python workers are pickled by value, so executors need the
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
