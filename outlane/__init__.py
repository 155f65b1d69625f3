"""Normal-only anomaly detection over large collections of series, on Spark.

The unit of work is a *dataset*: many TRAIN series (all normal) and many TEST
series.  A dataset is only a grouping column here, so one plan covers all of
them.  See README.md for the operator map.
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
