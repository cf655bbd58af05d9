"""Operators of a training-data pipeline.

Functions that run inside tasks travel by value, so the executors need only
PySpark, NumPy and Arrow, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
