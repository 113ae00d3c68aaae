"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

``source_targets`` spreads a word budget over the sources by weight: a source takes at most
``max_repeat`` times its own size, and what it can't take is shared out again by weight
among the others until none is above its limit.  Each round is one scalar aggregate over
the per-source table; no source list is sorted in one task or brought to the driver.

``mix`` then decides per row how often it is taken.  A source with target / size = k + f
takes every row k times, and once more those rows whose hash lies below a threshold chosen
so that their words add up to f of the source.  The threshold is found without sorting:
words are summed by (source, next bits of the hash); the bucket in which the running sum
passes the budget is the boundary; buckets below it are in, buckets above are out, and
only the boundary bucket's rows are looked at again with the next bits.

Defined results: a null text has size 0; a source without words takes its rows 0 times
and has target 0; a null source is a source like any other, after all others in order; rows with equal
(id, text) have equal hashes and are taken alike, so a target is met to within the words
of one hash value; an empty table gives an empty result.  Extra columns pass through.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.operators.ranking import global_row_number

from .common import WORD_RE, free_name, read_table, stored

HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def hash60(*cols: Column) -> Column:
    """A 60-bit hash both Spark and plain SQL can compute: 15 hex digits of an MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size long, weight int, target double) from (source, source_size).

    ``weights`` repeat over the sources in code point order, null last."""
    first = F.when(F.col("source").isNull(), 1).otherwise(0)
    ranked = global_row_number(sizes.withColumn("_null", first),
                               [("_null", True), ("source", True)], "_rn")
    spots = F.array(*[F.lit(int(w)) for w in weights])
    table = stored(ranked.select(
        "source", "source_size",
        F.element_at(spots, ((F.col("_rn") - 1) % len(weights) + 1).cast("int")).alias("weight")))
    limit = F.col("source_size") * max_repeat
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, full = None, F.lit(False)
    while True:
        free, taken = table.agg(F.sum(F.when(~full, F.col("weight"))),
                                F.sum(F.when(full, limit))).first()
        if not free:
            break
        new = (total - (taken or 0), free)
        if new == share:
            break
        share = new
        # a source is at its limit once weight / free * rest >= limit; compared in whole numbers
        full = F.col("weight").cast("decimal(38,0)") * F.lit(share[0]) >= limit.cast("decimal(38,0)") * F.lit(share[1])
    if share is None:
        return table.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    open_share = F.col("weight").cast("double") * F.lit(float(share[0])) / F.lit(float(share[1]))
    target = F.when(full, limit.cast("double")).otherwise(open_share)
    return table.select("source", "source_size", "weight", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(source, threshold): rows of a source with hash < threshold hold about ``budget`` words.

    ``rows`` has (source, h, size), ``budgets`` (source, budget long) with budget >= 0 for
    the sources to split.  Chosen is the cut nearest to the budget from above or below."""
    shift = HASH_BITS
    state = stored(budgets.select(F.col("source").alias("s"), F.lit(0).cast("bigint").alias("lo"),
                                  F.col("budget").cast("bigint").alias("left")))
    while shift > 0:
        step = min(level_bits, shift)
        width, shift = 1 << shift, shift - step
        inside = rows.join(state, rows["source"].eqNullSafe(state["s"])) \
                     .where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(width)))
        hist = inside.groupBy("s", "lo", "left", F.shiftright(F.col("h") - F.col("lo"), shift).alias("b")) \
                     .agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = hist.withColumn("cum", F.sum("words").over(upto))
        # the boundary: the first bucket that takes the running sum past what is left
        edge = run.where("cum > left").groupBy("s").agg(F.min(F.struct("b", "cum", "words", "h0", "h1")).alias("e"))
        nxt = state.join(edge.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select(
            "s", F.when(F.col("e").isNull(), F.col("lo") + F.lit(width))
                  .otherwise(F.col("lo") + F.shiftleft(F.col("e.b").cast("bigint"), shift)).alias("lo"),
            F.when(F.col("e").isNull(), F.lit(0)).otherwise(F.col("left") - (F.col("e.cum") - F.col("e.words"))).alias("left"),
            (F.col("e").isNull()).alias("done"), (F.col("e.h0") == F.col("e.h1")).alias("single"),
            F.col("e.words").alias("words"), F.col("e.h1").alias("h1"))
        # one hash value left in the boundary bucket: in if that lands nearer to the budget
        last = F.coalesce(F.col("single"), F.lit(False)) | F.lit(shift == 0)
        over = F.col("words") - F.col("left")
        nxt = nxt.select("s", F.when(~F.col("done") & last & (over < F.col("left")), F.col("h1") + 1)
                               .otherwise(F.col("lo")).alias("lo"),
                         F.when(F.col("done") | last, F.lit(True)).otherwise(F.lit(False)).alias("end"), "left")
        nxt = stored(nxt)
        ends = nxt.where("end").select(F.col("s").alias("source"), F.col("lo").alias("threshold"))
        done = ends if shift == HASH_BITS - step else done.union(ends)
        state = nxt.where("not end").select("s", "lo", "left")
        if state.isEmpty():
            break
    return done


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, *, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(plan, table): per row of ``docs`` (id_col, source, h, size, source_size, target, copies),
    and per source its targets and threshold.  ``copies`` is how often the mix takes the row."""
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                              hash60(F.col(id_col), F.coalesce(F.md5(F.col(text_col)), F.lit("-"))).alias("h"),
                              word_count(F.col(text_col)).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    size = F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    whole = F.least(F.floor(F.col("target") / size), F.lit(max_repeat)).cast("bigint")
    plan = stored(targets.withColumn("whole", whole).withColumn(
        "budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")))
    cut = thresholds(rows, plan.where("budget > 0").select("source", "budget"))
    table = stored(plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
                   .select("p.*", F.coalesce("c.threshold", F.lit(0)).alias("threshold")))
    t = table.withColumnRenamed("source", "src")
    # one row per source against all rows: a plain join, broadcast by Spark only below its size limit
    out = rows.join(t, rows["source"].eqNullSafe(t["src"])).select(
        F.col("id").alias(id_col), "source", "h", "size", "source_size", "target",
        (F.col("whole") + (F.col("h") < F.col("threshold")).cast("bigint")).alias("copies"))
    return out, table


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it (0 rows go)."""
    _, table = mix(docs, weights, max_repeat)
    part, copies = free_name(docs, "_mix"), free_name(docs, "_copies")
    t = table.select(F.struct("source", "whole", "threshold").alias(part))
    h = hash60(docs["doc_id"], F.coalesce(F.md5(docs["text"]), F.lit("-")))
    joined = docs.join(t, docs["source"].cast("string").eqNullSafe(F.col(part)["source"])) \
                 .withColumn(copies, F.col(part)["whole"] + (h < F.col(part)["threshold"]).cast("bigint")) \
                 .where(F.col(copies) > 0)
    again = free_name(joined, "_again")
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))) \
                 .select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    plan, _ = mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


# DuckDB SQL for op3_mixing: water filling by closed form over the sorted limits, and the
# cut by a running sum over the hashes of each source.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(md5(text), '-')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS ss FROM rows_ GROUP BY source),
wt AS (SELECT source, ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
tot AS (SELECT sum(ss)::BIGINT AS t, sum(w)::BIGINT AS tw FROM wt),
lim AS (SELECT source, ss, w,
          coalesce(sum(3 * ss) OVER o, 0)::BIGINT AS full_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
        FROM wt WINDOW o AS (ORDER BY 3.0 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_ AS (SELECT t - full_before AS rest, tw - w_before AS ow FROM lim, tot
          WHERE w * (t - full_before)::HUGEINT < 3 * ss::HUGEINT * (tw - w_before)
          ORDER BY 3.0 * ss / w LIMIT 1),
tgt AS (SELECT source, ss, CASE WHEN o.rest IS NULL OR w * o.rest::HUGEINT >= 3 * ss::HUGEINT * o.ow THEN (3 * ss)::DOUBLE
                           ELSE w::DOUBLE * o.rest::DOUBLE / o.ow::DOUBLE END AS target
        FROM wt LEFT JOIN open_ o ON true),
cut AS (SELECT source, ss, target, least(floor(target / greatest(ss, 1)::DOUBLE), 3)::BIGINT AS whole FROM tgt),
bud AS (SELECT *, round(target - whole * ss)::BIGINT AS budget FROM cut),
hs AS (SELECT source, h, sum(size)::BIGINT AS words FROM rows_ GROUP BY source, h),
run AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT AS cum FROM hs),
pick AS (SELECT r.source, r.h, b.budget > 0 AND (r.cum <= b.budget
                OR (r.cum - r.words < b.budget AND r.cum - b.budget < b.budget - (r.cum - r.words))) AS more
         FROM run r JOIN bud b ON r.source IS NOT DISTINCT FROM b.source)
SELECT r.doc_id, r.size, b.ss AS source_size, b.target, r.size * (b.whole + p.more::BIGINT) AS taken, r.source
FROM rows_ r JOIN bud b ON r.source IS NOT DISTINCT FROM b.source
JOIN pick p ON r.source IS NOT DISTINCT FROM p.source AND r.h = p.h
"""
