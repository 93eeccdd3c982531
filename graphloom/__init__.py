"""graphloom: property-graph analytics and data-processing operators on PySpark."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions of this package travel to executors by value, so a cluster needs no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
