"""Operators of a training-data pipeline: duplicates, licenses, leaks, toxicity, personal data, token files, packing, urls."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
