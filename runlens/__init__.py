"""Analyses of tool runs, their logs, costs and files, as Spark jobs.

Functions that run in Python workers travel by value, so that executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
