"""Session construction and the checkpoint directory rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every ordermill job relies on.  The session time zone is pinned to UTC
# because month/week/hour features are computed from TIMESTAMP_NTZ columns and the
# week truncation returns a zoned TIMESTAMP that is cast back.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "ordermill",
                shuffle_partitions: int | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the ordermill base settings.

    On a cluster, pass ``master=None`` and let spark-submit decide; the cluster's own
    ``spark.checkpoint.dir`` is respected (see :func:`ensure_checkpoint_dir`).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(BASE_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone",):
        spark.conf.set(key, settings[key])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only where none is set.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it from the
    session.  Only a local-mode session without the setting (tests, local runs) gets a
    private temporary folder; a cluster session without it is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the checkpoint folder)
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # executors cannot share a machine-local folder: require the cluster's shared one
            raise RuntimeError("spark.checkpoint.dir is not set; ordermill needs a shared folder "
                               "(e.g. on HDFS or an object store) for its checkpoints")
        configured = tempfile.mkdtemp(prefix="ordermill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, columnar: bool = False, bucket_by: tuple[str, ...] = ()):
    """Write ``df`` once into the reliable checkpoint folder and return the re-read frame.

    Used for frames that several later passes read (an entity-grain aggregate feeding a
    top-k, a total and a tie count; the master table feeding every analysis): their
    lineage is cut, nothing is recomputed per pass, and a lost executor re-reads files.
    ``columnar=True`` writes parquet instead of a row checkpoint, so readers that need
    a few columns (the analyses over the wide master) prune the rest at the scan.
    ``bucket_by`` writes parquet clustered by these columns, in as many buckets as shuffles have
    partitions, so that joins and aggregations on them read what belongs together without a
    shuffle.  It is for frames with one row per key: a bucket is read by one task."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if not columnar and not bucket_by:
        return df.checkpoint(eager=True)
    name = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/ordermill-tables/{name}"
    if not bucket_by:
        df.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        out.stored_at = path
        return out
    # the layout is known through the catalog; the files lie in the shared folder like all others
    table = f"ordermill_{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(table)
    return spark.table(table)


def app_key(spark: SparkSession) -> str:
    """Identifier of the running application (classic or Connect session)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", None) or str(id(spark))
