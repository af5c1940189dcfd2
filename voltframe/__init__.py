"""voltframe: a Spark-first analytics engine for extracellular recordings and their event tables."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so no copy of the package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
