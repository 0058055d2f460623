"""Safety-report analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from hazardlake.session import session

__all__ = ["session"]

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
