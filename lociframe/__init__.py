"""lociframe: sequence, interval and transcript analytics as PySpark DataFrame operations.

Coordinates inside the engine are BIGINT, 1-based and inclusive; only readers
and writers shift them.
"""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
