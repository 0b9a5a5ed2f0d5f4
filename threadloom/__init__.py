"""threadloom: conversational-evidence analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
