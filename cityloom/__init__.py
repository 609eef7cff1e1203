"""cityloom: Spark-first analytics for synthetic urban traffic.

Rasters, regions, road graphs, simulated flows and tensors are DataFrames; every
stage is a function from DataFrames to a DataFrame that Catalyst plans.
"""

import sys

from pyspark import cloudpickle

# Python kernels travel with the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
