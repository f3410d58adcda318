"""Log sweep and evidence analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from sweeplog.session import build_session

# Functions that run in Python workers travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
