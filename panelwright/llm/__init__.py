"""Operators for large text corpora (training-data preparation).

Nothing outside this subpackage imports it; `queries.py` holds the thin registered
queries, every other module one operator with its own general interface.
"""
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
