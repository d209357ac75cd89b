"""docketry: receipt text to expense rows, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to executors by value, so the package need
# not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
