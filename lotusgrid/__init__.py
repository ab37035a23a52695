"""lotusgrid: a PySpark engine for accident-risk tables and text corpora."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
