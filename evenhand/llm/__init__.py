"""Operators for large training corpora.

Functions of this folder travel to the tasks by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
