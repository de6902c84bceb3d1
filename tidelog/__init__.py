"""tidelog: ordered key-value logs, tenant metering and operation histories as Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions that tasks run travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
