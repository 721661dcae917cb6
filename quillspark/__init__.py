"""quillspark: a PySpark-native text-evidence analytics engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors are sent whole, so that no executor needs the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
