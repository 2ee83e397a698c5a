"""Retrieval analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
