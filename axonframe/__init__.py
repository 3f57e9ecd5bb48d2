"""Tractometry on Spark: streamlines, voxel grids, surfaces and fixels as DataFrames.

Every operator takes DataFrames and returns a DataFrame, so chains read as
``pts.transform(op, ...)`` and Catalyst sees one declarative plan.
"""

import sys

from pyspark import cloudpickle

# Ship the few Arrow helpers to the executors by value: no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
