"""Text-corpus engine on PySpark: page assembly, CJK paragraph reflow, script conversion, archives."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
