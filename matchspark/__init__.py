"""Talent matching and text features as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
