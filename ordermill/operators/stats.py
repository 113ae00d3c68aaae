"""Statistics: seeded hash sample, straight-line fit, box-plot numbers, histogram."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.operators.ranking import exact_quantiles, quantile_double
from ordermill.session import materialize

# Fixed values of the portable sample hash (Knuth's multiplicative constant, a Mersenne prime).
HASH_MULT = 2654435761
HASH_MOD = 2147483647


def sample_key(key: Column, dtype: T.DataType, seed: int) -> Column:
    """Seeded pseudo-random key.  Integral ids use ``((id mod p) * a + seed) mod p``,
    which any SQL engine reproduces; other ids use the lower 63 bits of ``xxhash64``."""
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        return F.pmod(F.pmod(key.cast("bigint"), F.lit(HASH_MOD)) * HASH_MULT + seed, F.lit(HASH_MOD))
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))


def hash_sample(df: DataFrame, key: str, k: int = 3000, seed: int = 42, oversample: int = 16) -> DataFrame:
    """The ``k`` rows with the smallest seeded hash of ``key`` (ties by ``key``, then by the other columns).

    A plain top-k would ship ``k`` candidates from every partition into one merging task.
    So one pass counts rows per class of the hash, ``oversample`` classes to a power of two
    (about a thousand in all, whatever the table), and the sample's rows lie in the classes up to the one
    in which the count reaches ``k``.  A class is ``2 ** (1 / oversample)`` times as wide as the one before, so
    hardly more than ``k`` rows pass on to the top-k at any size of table, unless many rows share
    one key.  No threshold is guessed, so there is no second try: with fewer than ``k`` rows all classes pass."""
    h = sample_key(F.col(key), df.schema[key].dataType, seed)
    cls = F.floor(F.log2(h.cast("double") + 1) * oversample).cast("int")
    classes = df.groupBy(cls.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # a null key has no hash: its rows come last, as they do in the order
    upto = classes.select("c", F.sum("n").over(Window.orderBy(F.col("c").asc_nulls_last())).alias("n"))
    last = upto.where(F.col("n") >= k).agg(F.min_by(F.coalesce("c", F.lit(1 << 16)), "n")).scalar()
    hashed = df.select("*", h.alias("_om_h"), F.coalesce(cls, F.lit(1 << 16)).alias("_om_c"))
    kept = hashed.where(F.col("_om_c") <= F.coalesce(last, F.lit(1 << 16)))
    ties = [F.col(c).asc_nulls_last() for c in df.columns if c != key and _orderable(df.schema[c].dataType)]
    return kept.orderBy(F.col("_om_h").asc_nulls_last(), F.col(key).asc_nulls_last(), *ties).limit(k).drop("_om_h", "_om_c")


def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """One row, ``n``: the exact number of different non-null values.

    Integer ids are set bits: bitmaps of 32,768 ids each, combined per task before the shuffle,
    so what travels is 4 KB per bitmap and not one row per id.  Other types take Spark's distinct
    count, which needs no copies of the rows for one column."""
    if isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ids = df.where(F.col(col).isNotNull())
        maps = ids.groupBy(F.bitmap_bucket_number(col).alias("_om_b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(col)).alias("_om_m"))
        return maps.agg(F.coalesce(F.sum(F.bitmap_count("_om_m")), F.lit(0)).cast("bigint").alias("n"))
    return df.agg(F.count_distinct(col).alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, points: int = 100, digits: int | None = None) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` evaluated at ``points`` evenly spaced x from
    min to max (the last point is exactly the max).  One aggregate row is exploded into
    the points: no join."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"),
        F.min(xd).alias("x_min"), F.max(xd).alias("x_max"))
    i = F.col("i")
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    xv = F.when(i == points - 1, F.col("x_max")).otherwise(F.col("x_min") + i.cast("double") * step)
    pts = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    yv = F.col("slope") * F.col("x") + F.col("intercept")
    out = pts.select(i.alias("point"), xv.alias("x"), "slope", "intercept").select(
        "point", "x", yv.alias("y"), "slope", "intercept")
    if digits is not None:
        out = out.select("point", *[F.round(c, digits).alias(c) for c in ("x", "y", "slope", "intercept")])
    return out.orderBy("point")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group: n, mean, q1, median, q3 (linear interpolation), the 1.5 IQR fences,
    whiskers (most extreme values inside the fences) and the outlier count.

    The rows are aggregated once into counts per (group, value) with map-side partial
    aggregation, which are written; quartiles, whiskers, outliers and the mean all come from that frame,
    whose size is the number of distinct values, so no raw row is joined or re-read."""
    by = list(by)
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*by, value)
                         .agg(F.count(F.lit(1)).alias("_om_c")), columnar=True)
    q = exact_quantiles(counts, value, [0.25, 0.5, 0.75], by, count_col="_om_c")
    q = q.select(*by, quantile_double(F.col("q0")).alias("q1"), quantile_double(F.col("q1")).alias("median"),
                 quantile_double(F.col("q2")).alias("q3"))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    v, c = F.col(value).cast("double"), F.col("_om_c")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    g = (counts.join(q, by)
         .groupBy(*by, "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
             F.sum(c).alias("n"),
             F.try_divide(F.sum(F.col(value) * c).cast("double"), F.sum(c)).alias("mean"),
             F.min(F.when(inside, v)).alias("whisker_low"),
             F.max(F.when(inside, v)).alias("whisker_high"),
             F.coalesce(F.sum(F.when(~inside, c)), F.lit(0)).alias("outliers")))
    return g.select(*by, "n", "mean", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                    "whisker_low", "whisker_high", "outliers").orderBy(*by)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins; the max falls in the last
    bin.  Returns every bin (bin, bin_lo, bin_hi, count).  The range is a one-row
    aggregate used as a scalar subquery; the bins come from exploding that row."""
    v = F.col(value).cast("double")
    rng = df.where(v.isNotNull()).agg(F.min(v).alias("lo0"), F.max(v).alias("hi0"))
    # a zero-width range is widened by 0.5 on both sides (numpy's rule)
    rng = rng.select(F.when(F.col("hi0") > F.col("lo0"), F.col("lo0")).otherwise(F.col("lo0") - 0.5).alias("lo"),
                     F.when(F.col("hi0") > F.col("lo0"), F.col("hi0")).otherwise(F.col("hi0") + 0.5).alias("hi"))
    lo, hi = F.col("_om_rng")["lo"], F.col("_om_rng")["hi"]
    idx = F.least(F.floor((v - lo) / (hi - lo) * bins) + 1, F.lit(bins)).cast("int")
    counts = (df.where(v.isNotNull()).withColumn("_om_rng", rng.select(F.struct("lo", "hi")).scalar())
              .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    b, lo, hi = F.col("bin"), F.col("lo"), F.col("hi")
    width = (hi - lo) / bins
    frame = rng.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return (frame.join(counts, "bin", "left")
            .select("bin", (lo + (b - 1).cast("double") * width).alias("bin_lo"),
                    F.when(b == bins, hi).otherwise(lo + b.cast("double") * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count"))
            .orderBy("bin"))
