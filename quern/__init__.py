"""quern: table, text, vector and model preparation as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors do not need
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
