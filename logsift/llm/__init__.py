"""Operations of a training-data pipeline: deduplication, filtering, mixing, tokens and search."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need not have
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
