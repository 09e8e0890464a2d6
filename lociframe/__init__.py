"""lociframe: statistical-genetics analytics as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel to executors with the tasks, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
