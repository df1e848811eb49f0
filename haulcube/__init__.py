"""haulcube: weekly tonnage analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects
(or Columns) and is generic over column names; the heavy lifting is left
to Catalyst / Tungsten, with Arrow-batched pandas functions only where
the built-in operators cannot express the algorithm.
"""
__version__ = "0.1.0"

# Functions that run inside tasks (pandas UDFs, applyInPandas/mapInPandas
# bodies) are shipped by value, so executors need no copy of this package on
# their import path.
import sys as _sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
