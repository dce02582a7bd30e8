"""granary: tabular analytics and machine learning expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Arrow batches are shipped by value, so executors
# need nothing of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
