"""Operators of a training-data pipeline over web pages and documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
