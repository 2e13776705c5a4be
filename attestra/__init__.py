"""Evidence qualification as Spark jobs: DataFrame operators, no engine of its own."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so workers need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
