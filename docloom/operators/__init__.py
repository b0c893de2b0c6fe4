"""Operators: DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Folds run on executors; they travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
