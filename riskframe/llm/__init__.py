"""Operators of a training-data pipeline: de-duplication, tokenising, filtering, sharding.

Every operator takes and returns DataFrames.  Nothing else in the library imports this
subpackage.  ``queries`` registers one query per operator.

The functions that run inside Python tasks are pickled by value, so executors need the
third-party packages (numpy, pyarrow, xxhash) but not this library on their path.
"""

from pyspark import cloudpickle as _cp
import sys as _sys

_cp.register_pickle_by_value(_sys.modules[__name__])
