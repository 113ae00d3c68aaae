"""Operators of a large-scale training-data pipeline, each over whole Spark tables.

Every operator takes and returns DataFrames, runs its heavy part in Spark tasks and keeps
only frames of a stated, bounded size on the driver.  ``registry.queries()`` holds one
query per operator, ``registry.oracle_sql()`` the DuckDB equivalents where SQL can express
the result.  Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# tasks get this package's functions with the job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
