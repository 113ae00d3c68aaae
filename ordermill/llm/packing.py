"""Packing token pieces into sequences by minimum bin slack.

Documents are encoded, closed by the end id, and only those longer than a sequence are cut.
What is packed is then the histogram of piece lengths, at most ``size`` rows however large
the corpus: a bin is seeded with the longest piece left, a bitset subset-sum over the
lengths still available (with their counts) finds the fullest feasible combination for the
rest, and the combination is removed as often as the counts allow before the next one is
sought.  Each removal at least halves the count of some length or exhausts it, so there are
fewer than 2.5 * size combinations, of at most sqrt(2 * size) lengths each, whatever the
input.  The plan is intervals of ranks per length; every piece finds its place from its
rank among the pieces of equal length.

Ranks come from counts per (length, hash bucket), prefix sums over the buckets and a row
number inside a bucket, so one frequent length never meets in one task.

Defined results: null and empty texts are the end id alone; repeated rows are packed each;
null ids are packed like others; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, row_hash, stored
from .encoding import encoded

END, SIZE = 1, 4096
BUCKET_ROWS = 20_000  # pieces that a hash bucket holds on average


def cut_pieces(docs: DataFrame, tokenizer: str, *, size: int = SIZE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        for part, rows in encoded(batches, tokenizer):
            out = []
            for key, ids in zip(part.column(0).to_pylist(), rows):
                ids += end
                step = 4 * size
                for k, lo in enumerate(range(0, len(ids), step)):
                    body = ids[lo:lo + step]
                    out.append((key, k, lo // 4, len(body) // 4, zlib.crc32(body)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
               .mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``, as
    {length: times}; among equals the one that uses long pieces."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if 0 < n <= room and c > 0), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:  # binary splitting of the count
            times = min(times, left)
            grown = reach | (reach << (length * times)) & mask
            if grown != reach:
                steps.append((reach, length, times))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + times
            at -= length * times
    return out


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """[(number of sequences, {length: times per sequence})] that place every piece."""
    counts, out = dict(histogram), []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fullest(counts, size - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        repeat = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= repeat * k
            if not counts[n]:
                del counts[n]
        out.append((repeat, chosen))
    return out


def intervals(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """{length: rows (first rank, first sequence, times per sequence, offset)} by first rank."""
    used, out, sequence = {}, {}, 0
    for repeat, chosen in plan:
        at = 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            out.setdefault(n, []).append((used.get(n, 0), sequence, k, at))
            used[n] = used.get(n, 0) + repeat * k
            at += n * k
        sequence += repeat
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with doc_id, piece, length <= size, ids_crc32) plus sequence_id and offset."""
    pieces = stored(pieces)
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = pieces.withColumn("_b", row_hash(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")) % buckets)
    sums = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n"))
    sums = stored(sums)
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # at most ``size`` rows
    histogram = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}
    places = intervals(plan_bins(histogram, size))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("_rn", F.row_number().over(inside)) \
                  .join(base, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_rn") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")

    def place(frames):
        for pdf in frames:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                rows = places[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                q = rank[here] - row[:, 0]
                seq[here] = row[:, 1] + q // row[:, 2]
                off[here] = row[:, 3] + q % row[:, 2] * n
            yield pdf.drop(columns="_rank").assign(sequence_id=seq, offset=off)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_pieces(docs, tokenizer, size=size), size)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
