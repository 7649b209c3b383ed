"""Contract-event analytics as PySpark DataFrame functions.

Every public function takes DataFrames (or columns) and returns DataFrames (or
columns); nothing collects rows to the driver and nothing opens a session.
"""

import sys

from pyspark import cloudpickle

# Batch functions travel to executors by value, so a cluster needs no copy of
# this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
