"""basketry: retail customer and demand analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Grouped functions travel to executors by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
