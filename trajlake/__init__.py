"""Rollout-trajectory analytics as Spark DataFrame operators.

Modules: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (table jobs), ``streaming`` (the same jobs on streams) and
``plans`` (the query catalogue over the TPC-H-like test tables).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
