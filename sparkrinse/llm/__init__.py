"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Functions of this package that run inside Python tasks are shipped with the job, so executors do not
need the package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
