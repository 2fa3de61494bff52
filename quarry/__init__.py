"""quarry: retrieval, ranking and ingestion operators written as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain Python parameters) and
returns a DataFrame; nothing is collected on the driver except inputs whose
size is checked against an explicit bound (query vectors for a broadcast).
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Python workers (Arrow/pandas UDFs)
# are pickled by value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quarry.session import get_session, shared_dir  # noqa: E402

__all__ = ["get_session", "shared_dir"]
