"""Document-evidence analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with all they need: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
