"""Quality scoring, ranking and grouping of large item tables on Spark.

Functions shipped to executors are pickled by value, so a cluster needs no
installation of this package beyond the driver.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
