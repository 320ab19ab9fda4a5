"""sievegrid: Spark-native preparation, auditing and judging of labelled text and HTTP events.

Functions of this package that run in Python workers are pickled by value, so
executors need no copy of the package on their path.
"""

import sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, ValueError):  # pragma: no cover - pyspark without the bundled pickler
    pass

__version__ = "0.1.0"
