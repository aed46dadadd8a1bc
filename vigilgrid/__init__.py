"""Camera-fleet analytics expressed as Spark DataFrames and streams."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
