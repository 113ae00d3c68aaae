"""ordermill: marketplace order analytics as Spark DataFrame operators.

Every public operator is a function from DataFrames to a DataFrame, built from native
Spark expressions (no Python UDF in any hot path).  Most are lazy; those that rank or
take exact quantiles write a frame to the checkpoint folder when called.  The layout:

* ``ordermill.sources``   role schemas, CSV/parquet readers, the test-table adapter, sinks
* ``ordermill.functions`` Column helpers (exact rounding, time features, fixed labels)
* ``ordermill.operators`` cleaning, per-order picks, quality reports, distributed ranking, statistics
* ``ordermill.plans``     the order-grain master table, the ten SQL analyses, the master analyses
"""

from ordermill.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
