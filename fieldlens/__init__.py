"""Sports tracking analytics as Spark jobs: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code, so it need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
