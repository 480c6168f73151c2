"""Visitor-flow analytics as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# the few Python functions that run inside tasks travel with them, so that the
# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
