"""Date, file, reconcile and deduplicate a media archive with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python tasks carry their functions along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
