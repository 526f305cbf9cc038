"""A pipe-style query language and its engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
