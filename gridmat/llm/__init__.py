"""Operators for preparing training data: one module each, and the queries over the tables."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the job; the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
