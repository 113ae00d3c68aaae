"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds numbered shards; shard k has three flat little-endian files:

* ``kind=ids/part-k``: the ids of its documents one after the other, each document closed
  by the end id 0, as uint16; a vocabulary with larger ids is refused with a ValueError;
* ``kind=off/part-k``: per document an int64, the position in the shard after its end id;
* ``kind=doc/part-k``: per document two int64, the low 48 and the high 16 bits of its id
  (bit 16 of the second is set for a null id).

Documents ascend by id through the shards, null ids first, equal ids by a hash of the text.
The files are written by Spark's own text sink, so task commit, retries and any store that
Spark can write to work as usual: a row is raw bytes, and the sink's line separator is the
zero bytes that every entry ends with anyway (the end id; the zero top of an offset, which
is below 2**48 per shard).

Readers map the files into memory; the first position of a shard is the prefix sum of the
shard lengths.  Defined results: null and empty texts give the end id alone, an empty table
an empty folder and no rows, repeated rows are written as often as they come, other columns
play no part.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_folder
from .encoding import binary, encoded

END = 0
TASK_BYTES = 4 << 20  # bytes that a reading task takes at least, where there are more


def id_width(path: str) -> int:
    """Bytes per id: 2 if all ids of the tokenizer are below 2**16, else 4."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return 2 if top < 1 << 16 else 4


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Write the ids of all ``docs`` below ``folder`` in the format above; returns ``folder``."""
    width = id_width(tokenizer)
    spare = 8 - width

    def run(batches):
        seq = at = 0
        for part, rows in encoded(batches, tokenizer):
            ids = [np.frombuffer(r, "<u4") for r in rows]
            body = [x.astype("<u2").tobytes() for x in ids] if width == 2 else rows
            ends = at + np.cumsum([len(x) + 1 for x in ids])
            at = int(ends[-1])
            keys = part.column(0).to_pylist()
            low = [((k or 0) & 0xFFFFFFFFFFFF) for k in keys]
            high = [((k >> 48) & 0xFFFF) if k is not None else 1 << 16 for k in keys]
            pairs = [v.to_bytes(8, "little") for p in zip(low, high) for v in p]
            offs = [int(e).to_bytes(8, "little") for e in ends]
            n = len(rows)
            # entries end with the separator's zero bytes, which the sink adds
            kinds = ["ids"] * n + ["off"] * n + ["doc"] * 2 * n
            values = body + [o[:spare] for o in offs] + [p[:spare] for p in pairs]
            order = np.concatenate([seq + np.arange(n), seq + np.arange(n), 2 * seq + np.arange(2 * n)])
            seq += n
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(order, pa.int64()), binary(values)],
                                             ["kind", "seq", "value"])

    if width == 4:
        raise ValueError("the vocabulary needs 4-byte ids, for which document ids don't fit the entry format")
    sort = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")) \
               .repartitionByRange(*sort[:2]).sortWithinPartitions(*sort) \
               .mapInArrow(run, "kind string, seq bigint, value binary")
    rows.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value")) \
        .write.partitionBy("kind").option("lineSep", "\0" * width).option("compression", "none").text(folder)
    return folder


def mapped(path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the path is a file's, else read."""
    if path.startswith("file:"):
        local = "/" + path[5:].lstrip("/")
        return np.memmap(local, dtype=dtype, mode="r")
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def shards(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """One row per shard: (shard, ids, off, doc: paths, n_ids, base: ids in all shards before)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
                 .option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    files = files.select(F.regexp_extract("path", r"/part-(\d+)-", 1).cast("int").alias("shard"),
                         F.regexp_extract("path", r"/kind=(\w+)/", 1).alias("kind"), "path", "length")
    def pick(kind, column):
        """The one file of a kind; a second one of the same number would be lost, so it is an error."""
        mine = F.when(F.col("kind") == kind, F.col(column))
        return F.when(F.count(mine) > 1, F.raise_error(F.lit("a shard has several files of a kind; "
                      "write with spark.sql.files.maxRecordsPerFile at 0"))).otherwise(F.max(mine))
    rows = files.groupBy("shard").agg(*[pick(k, "path").alias(k) for k in ("ids", "off", "doc")],
                                      (pick("ids", "length") / width).cast("bigint").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tasks(pieces: int, size: int) -> int:
    """Tasks that read ``size`` bytes in that many pieces."""
    return max(1, min(int(pieces), -(-int(size) // TASK_BYTES)))


def read_tokens(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, off = mapped(r["ids"], f"<u{width}"), mapped(r["off"], "<i8")
                pairs = mapped(r["doc"], "<i8").reshape(-1, 2)
                keys = pairs[:, 0] | ((pairs[:, 1] & 0xFFFF) << 48)
                null = pairs[:, 1] >> 16 == 1
                starts = np.concatenate([[0], off[:-1]])
                for lo in range(0, len(off), 4096):
                    hi = min(lo + 4096, len(off))
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[lo:hi], off[lo:hi])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo:hi], pa.int64(), mask=null[lo:hi]),
                         pa.array(starts[lo:hi] + r["base"], pa.int64()),
                         pa.array(off[lo:hi] - starts[lo:hi], pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    # few small rows, one per shard, that stand for much work: a stated number of tasks, which is
    # not merged for the rows' small size
    table = shards(spark, folder, width)
    files, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0)) * width).first()
    return table.repartitionByRange(read_tasks(files, size), "shard") \
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = write_tokens(docs, tokenizer, shared_folder(spark, "tokens"))
    return read_tokens(spark, folder, id_width(tokenizer))
