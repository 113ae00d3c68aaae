"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.session import ensure_checkpoint_dir, materialize

# the bytes that separate words in every word count and shingle of this package
SPACES = " \\t\\n\\x0B\\f\\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
BATCH = 4 << 20  # bytes of an Arrow batch of texts, at most (or one row)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _within(settings: dict[str, str]):
    """A decorator: jobs that run inside a function of a DataFrame first have these session settings."""
    def held(step):
        @wraps(step)
        def run(df: DataFrame, *args, **kwargs):
            conf = df.sparkSession.conf
            before = {name: conf.get(name, None) for name in settings}
            for name, value in settings.items():
                conf.set(name, value)
            try:
                return step(df, *args, **kwargs)
            finally:
                for name, value in before.items():
                    if value is None:
                        conf.unset(name)
                    else:
                        conf.set(name, value)

        return run

    return held


# rows go to Python in Arrow batches of so many bytes: a batch of texts lies in the memory of the executor and of
# its worker at once
small_batches = _within({"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)})
# shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage, which it
# does the more seldom, for its input, the larger that is
short_shuffles = _within({"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@short_shuffles
def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet in the shared checkpoint folder and read back: the
    lineage is cut, later passes prune columns, a lost executor re-reads files."""
    return materialize(df, columnar=True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames from :func:`stored` that nothing reads any more; a frame that still reads one
    of them fails."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder (not yet created) below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordermill-{kind}/{uuid.uuid4().hex}"


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(texts: pa.Array, rows: int, size: int):
    """(first row, number of rows) of consecutive slices of a column of texts: at most ``rows`` rows and
    ``size`` bytes, or one row."""
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(lengths, dtype=np.int64), 0
    while lo < len(ends):
        room = size + (int(ends[lo - 1]) if lo else 0)
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, room, side="right"))))
        yield lo, hi - lo
        lo = hi


def row_hash(*cols: Column) -> Column:
    """63-bit non-negative hash of the columns' values; depends on nothing else."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser over an unsigned integer array (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, root), root the smallest node
    of the component.  ``edges`` has columns (a, b) of one orderable type; loops and repeats
    are allowed.  Only nodes that have an edge to another node are returned.

    Every round points each node to its smallest neighbour, follows that pointer once more,
    and contracts the edges onto the targets; the nodes left at least halve, so the number
    of rounds is logarithmic.  All rounds are joins and partial aggregates: a hub's edges
    are never gathered into one row."""
    live = stored(edges.where("a <> b").select("a", "b").distinct())
    maps = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")) \
                    .select("node", F.least("node", "low").alias("to"))
        point = stored(point)
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = stored(point.join(hop, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stored(live.join(left, "a").join(right, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("then"))
        out = stored(out.join(nxt, "root", "left").select("node", F.coalesce("then", "root").alias("root")))
    # a root may differ from the smallest member while pointers were followed: settle it
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    return out.join(least, "root").select("node", F.least("root", "least").alias("root"))
