"""lexspan: audit, segment, search and check document corpora as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the functions that run in Python workers with the job, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
