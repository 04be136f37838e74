"""curate: corpus curation and dataset analytics as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value, so that executors need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
