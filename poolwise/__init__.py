"""poolwise: pool-based training-data selection as Spark jobs.

Functions of this package that run inside Python workers (``mapInPandas``
bodies) are pickled by value, so executors need no installed copy of it.
"""

import sys as _sys

try:  # PySpark bundles cloudpickle
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
