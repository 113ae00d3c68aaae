"""Global ranking, NTILE, running sums and exact quantiles without a single-task window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.  Here a
global order is computed in three distributed steps, all JVM-native:

1. ``repartitionByRange`` on the full sort key (the caller's unique id is part of it, so
   heavily tied values still spread over many partitions), then a local sort, then
   ``monotonically_increasing_id()`` which encodes (partition, position in partition);
   the result is ``checkpoint()``-ed to the cluster's reliable checkpoint folder, which
   pins the sampled range bounds so that a lost executor or a second read can never see
   a different partitioning;
2. per-partition counts (and sums) form a frame with one row per partition, whose prefix
   sums are broadcast back as offsets; running sums inside a partition are a window keyed
   by the pinned partition id;
3. rank = offset + local position.

That is what a rank for *every* row costs.  NTILE scores and quantiles only need the rows at a few
places of the order, which :mod:`ordermill.operators.selection` finds by counting; they are the default
(``method="select"`` and ``"count"``), with the ranking as ``method="range"``.
"""

from __future__ import annotations

from fractions import Fraction
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.functions.exact import div_floor
from ordermill.operators.selection import Order, select_ranks, selectable, steps, tile_borders
from ordermill.session import ensure_checkpoint_dir

MAX_BORDERS = 100  # tiles that are scored by comparison

_PID, _LRN = "_om_pid", "_om_lrn"
_LOW_MASK = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | position


def _sort_exprs(order: Order) -> list[Column]:
    # ascending: nulls first, descending: nulls last (Spark's defaults, spelled out)
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def ranked(df: DataFrame, order: Order, *, rank_col: str = "rn", total_col: str | None = None,
           sum_cols: Sequence[str] = (), partitions: int | None = None,
           total_sum_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position in ``order`` (must be a total order: end it
    with a unique id), optionally ``total_col`` = row count, and for each integral column
    ``c`` in ``sum_cols`` an inclusive running sum ``cum_<c>`` (and, with
    ``total_sum_col``, the grand total of the first of them).

    ``monotonically_increasing_id()`` evaluated right after the local sort encodes the
    partition index (upper 31 bits) and the row's position in the sorted partition (lower
    33 bits); the checkpoint pins both together with the sampled range bounds."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sorts = _sort_exprs(order)
    vcols = [f"_om_v_{c}" for c in sum_cols]
    base = df.select(*df.columns, *[F.col(c).cast("bigint").alias(v) for c, v in zip(sum_cols, vcols)])
    # without an explicit count AQE may merge adjacent ranges (order is kept) to its
    # advisory partition size; the partition index is read per task either way
    ranged = base.repartitionByRange(partitions, *sorts) if partitions else base.repartitionByRange(*sorts)
    local = (ranged
             .sortWithinPartitions(*sorts)
             .withColumn("_om_mid", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    local = (local.withColumn(_PID, F.shiftright(F.col("_om_mid"), 33))
             .withColumn(_LRN, F.col("_om_mid").bitwiseAND(F.lit(_LOW_MASK)) + 1))
    if vcols:
        # running sums inside each range partition: a window keyed by the pinned partition id
        within = Window.partitionBy(_PID).orderBy(_LRN).rowsBetween(Window.unboundedPreceding, 0)
        local = local.select("*", *[F.sum(v).over(within).alias(f"_om_lcum_{v}") for v in vcols])
    totals = local.groupBy(_PID).agg(F.count(F.lit(1)).alias("_om_cnt"),
                                     *[F.sum(v).alias(f"_om_tot_{v}") for v in vcols])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # ``totals`` has one row per range partition: a single-partition window over it is bounded.
    offsets = totals.select(
        _PID,
        F.coalesce(F.sum("_om_cnt").over(before), F.lit(0)).alias("_om_off"),
        F.sum("_om_cnt").over(everything).alias("_om_n"),
        *[F.coalesce(F.sum(f"_om_tot_{c}").over(before), F.lit(0)).alias(f"_om_offs_{c}") for c in vcols],
        *[F.sum(f"_om_tot_{c}").over(everything).alias(f"_om_all_{c}") for c in vcols])
    out = local.join(F.broadcast(offsets), _PID)
    cols = [F.col(c) for c in df.columns] + [(F.col("_om_off") + F.col(_LRN)).alias(rank_col)]
    if total_col:
        cols.append(F.col("_om_n").alias(total_col))
    for c, v in zip(sum_cols, vcols):
        cols.append((F.col(f"_om_offs_{v}") + F.col(f"_om_lcum_{v}")).alias(f"cum_{c}"))
    if total_sum_col and vcols:
        cols.append(F.col(f"_om_all_{vcols[0]}").alias(total_sum_col))
    return out.select(*cols)


def ntile_from_rank(rank: Column, n: Column, buckets: int) -> Column:
    """SQL ``NTILE(buckets)`` from a 1-based rank and the row count: the first
    ``n % buckets`` tiles hold one extra row."""
    q = div_floor(n, F.lit(buckets))
    m = n - q * buckets
    big = m * (q + 1)

    def ceil_div(a, b):
        return div_floor(a + b - 1, b)

    return F.when(rank <= big, ceil_div(rank, q + 1)) \
            .otherwise(m + ceil_div(rank - big, F.greatest(q, F.lit(1)))).cast("bigint")


def global_row_number(df: DataFrame, order: Order, name: str = "rn", *, method: str = "range",
                      partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY ...)`` for the whole frame.

    ``method="window"`` uses Spark's own unpartitioned window (one task; for tests)."""
    if method == "window":
        return df.withColumn(name, F.row_number().over(Window.orderBy(*_sort_exprs(order))).cast("bigint"))
    return ranked(df, order, rank_col=name, partitions=partitions)


def global_ntile(df: DataFrame, buckets: int, order: Order, name: str = "ntile", *,
                 method: str = "select", partitions: int | None = None) -> DataFrame:
    """``NTILE(buckets) OVER (ORDER BY ...)`` for the whole frame (order must be total).

    ``"select"`` reads the frame a few times to find the borders of the tiles and scores each row
    by comparison, for up to ``MAX_BORDERS`` tiles (each is a comparison per row); ``"range"``, which more
    tiles take too, ranks all rows; ``"window"`` is Spark's own one-task window."""
    if method == "window":
        return df.withColumn(name, F.ntile(buckets).over(Window.orderBy(*_sort_exprs(order))).cast("bigint"))
    if method == "select" and buckets <= MAX_BORDERS:
        return ntiles(df, buckets, {name: order})
    r = ranked(df, order, rank_col="_om_rank", total_col="_om_total", partitions=partitions)
    return r.withColumn(name, ntile_from_rank(F.col("_om_rank"), F.col("_om_total"), buckets)) \
            .drop("_om_rank", "_om_total")


def ntiles(df: DataFrame, buckets: int, orders: dict[str, Order]) -> DataFrame:
    """Several NTILE columns (name -> total order) whose borders the same passes find."""
    found = select_ranks(df, list(orders.values()), [tile_borders(buckets)] * len(orders))
    return df.select("*", *[steps(df, order, borders).alias(name)
                            for (name, order), (_, borders) in zip(orders.items(), found[()])])


# ---------------------------------------------------------------------------------------
# exact quantiles
# ---------------------------------------------------------------------------------------

def _fraction(p: float) -> Fraction:
    """The probability as the exact fraction of its decimal text."""
    f = Fraction(str(p))
    if f.denominator > 10 ** 9:  # ranks are multiplied by it in 64 bits
        raise ValueError(f"probability {p!r} has more than nine decimals")
    return f


def quantile_places(probs: Sequence[float], n: int) -> list[tuple[int, int, int, int]]:
    """Per probability (lower place, upper place, rem, den) around position (n - 1) * p, from 0."""
    out = []
    for p in probs:
        f = _fraction(p)
        at, rem = divmod((n - 1) * f.numerator, f.denominator)
        out.append((at, min(at + 1, n - 1), rem, f.denominator))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    *, method: str = "count", partitions: int | None = None, count_col: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (numpy/pandas default, ``quantile_cont``), exactly.

    Returns one row per group of ``by`` with, for every probability ``i``, a struct
    ``q{i}`` = (lo, hi, rem, den): the quantile is ``lo + (hi - lo) * rem / den`` where
    ``lo``/``hi`` are the order statistics around position ``(n - 1) * p``.  Keeping the
    rational form lets callers compare or round without any floating error.

    ``method="count"`` (integers and decimals) finds the order statistics by counting passes and
    returns literals; groups are few.  ``method="range"`` (any type, any number of groups) counts per
    distinct value, ranks those globally (see :func:`ranked`) and stays a plan.
    With ``count_col`` the input already holds one row per (group, value) with its count.
    """
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
    dtype = df.schema[value].dataType
    for p in probs:
        _fraction(p)
    if method == "count" and isinstance(dtype, numeric) and selectable(dtype):
        return _counted_quantiles(df, value, probs, list(by), count_col)
    return _ranged_quantiles(df, value, probs, by, partitions, count_col)


def _counted_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: list[str],
                       count_col: str | None) -> DataFrame:
    rows_of = df.where(F.col(value).isNotNull())
    for c in by:
        rows_of = rows_of.where(F.col(c).isNotNull())
    wanted = lambda n: [at for q in quantile_places(probs, n) for at in q[:2]]
    found = select_ranks(rows_of, [[(value, True)]], [wanted], by=by, weight=count_col)
    dtype = df.schema[value].dataType.simpleString()
    rows = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(by, group)],
                     F.lit(n or None).cast("bigint").alias("n"), quantile_structs(df, value, probs, n, places).alias("q"))
            for group, ((n, places),) in found.items()]
    q = ", ".join(f"q{i}: struct<lo: {dtype}, hi: {dtype}, rem: bigint, den: bigint>" for i in range(len(probs)))
    kinds = [f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in by] + ["n: bigint", f"q: struct<{q}>"]
    table = F.array(*rows).cast(f"array<struct<{', '.join(kinds)}>>")
    return df.sparkSession.range(1).select(F.inline(table)).select(*by, "n", "q.*")


def quantile_structs(df: DataFrame, value: str, probs: Sequence[float], n: int, places: list[tuple]) -> Column:
    """A struct of the quantile structs of :func:`exact_quantiles` as literals, from the order
    statistics at the :func:`quantile_places` of ``n`` rows (two per probability)."""
    dtype = df.schema[value].dataType
    out = []
    for i, (_, _, rem, den) in enumerate(quantile_places(probs, n)):
        lo, hi = (places[2 * i + k][0] if n else None for k in (0, 1))
        out.append(F.struct(F.lit(lo).cast(dtype).alias("lo"), F.lit(hi).cast(dtype).alias("hi"),
                            F.lit(rem if n else None).cast("bigint").alias("rem"),
                            F.lit(den).cast("bigint").alias("den")).alias(f"q{i}"))
    return F.struct(*out)


def _ranged_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str],
                      partitions: int | None, count_col: str | None) -> DataFrame:
    by = list(by)
    if count_col:
        counts = df.where(F.col(value).isNotNull()).select(*by, value, F.col(count_col).alias("_om_c"))
    else:
        counts = (df.where(F.col(value).isNotNull())
                  .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_om_c")))
    order = [(c, True) for c in by] + [(value, True)]
    r = ranked(counts, order, rank_col="_om_r", sum_cols=["_om_c"], partitions=partitions,
               total_sum_col="_om_all")
    r = r.withColumn("_om_first", F.col("cum__om_c") - F.col("_om_c"))   # global 0-based start
    if by:
        starts = r.groupBy(*by).agg(F.min("_om_first").alias("_om_g0"), F.sum("_om_c").alias("_om_gn"))
        r = r.join(starts, by)
    else:
        r = r.withColumn("_om_g0", F.lit(0).cast("bigint")).withColumnRenamed("_om_all", "_om_gn")
    lo_pos = F.col("_om_first") - F.col("_om_g0")            # 0-based first index of this value in group
    hi_pos = lo_pos + F.col("_om_c") - 1
    aggs = []
    for i, p in enumerate(probs):
        fr = _fraction(p)
        num = (F.col("_om_gn") - 1) * fr.numerator
        idx = div_floor(num, F.lit(fr.denominator))
        rem = num - idx * fr.denominator
        nxt = F.least(idx + 1, F.col("_om_gn") - 1)
        v = F.col(value)
        aggs += [F.max(F.when((lo_pos <= idx) & (idx <= hi_pos), v)).alias(f"_q{i}_lo"),
                 F.max(F.when((lo_pos <= nxt) & (nxt <= hi_pos), v)).alias(f"_q{i}_hi"),
                 F.max(rem).alias(f"_q{i}_rem")]
    g = (r.groupBy(*by).agg(*aggs, F.max("_om_gn").alias("n")) if by
         else r.agg(*aggs, F.max("_om_gn").alias("n")))
    out = [*by, "n"]
    for i, p in enumerate(probs):
        fr = _fraction(p)
        out.append(F.struct(F.col(f"_q{i}_lo").alias("lo"), F.col(f"_q{i}_hi").alias("hi"),
                            F.col(f"_q{i}_rem").cast("bigint").alias("rem"),
                            F.lit(fr.denominator).cast("bigint").alias("den")).alias(f"q{i}"))
    return g.select(*out)


def quantile_double(q: Column) -> Column:
    """Numeric value of a quantile struct from :func:`exact_quantiles`."""
    lo, hi = q["lo"].cast("double"), q["hi"].cast("double")
    return lo + (hi - lo) * (q["rem"].cast("double") / q["den"].cast("double"))


def le_quantile(x: Column, q: Column) -> Column:
    """``x <= quantile`` evaluated exactly (integral or decimal ``x``)."""
    return x * q["den"] <= q["lo"] * q["den"] + (q["hi"] - q["lo"]) * q["rem"]
