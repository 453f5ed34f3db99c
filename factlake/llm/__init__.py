"""Training-data operators: filtering, deduplication, mixing, packing and token output on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code along, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
