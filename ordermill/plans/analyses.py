"""Analyses over the master table (the pandas half of the reference).

Means are ``sum / count`` of exact sums (one division, as pandas does after summing),
sums of an all-null group are 0, group keys that are null are dropped (pandas
``groupby``).  Global scalars (max orders, snapshot date, quantile edges, histogram
range) are one-row aggregates used through scalar subqueries, never collected.
Month and week windows run over the month/week aggregates, which are bounded by the
calendar, not by the data size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.functions.labels import (SEGMENTS, SEVERITY_BANDS, SEVERITY_LABELS, TIER_CUTS,
                                        TIER_LABELS, WEEKDAYS)
from ordermill.functions.time import floor_days, month_label, week_start
from ordermill.operators.ranking import exact_quantiles, le_quantile, quantile_places, quantile_structs
from ordermill.operators.selection import select_ranks, steps
from ordermill.operators.stats import box_stats, distinct_count, hash_sample, histogram, linear_fit
from ordermill.session import materialize


def _mean(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def _zero_sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def _maybe_round(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


# ---------------------------------------------------------------------------------------
# revenue over time
# ---------------------------------------------------------------------------------------

def monthly_trend(master: DataFrame) -> DataFrame:
    """month, revenue, orders, avg_order (mean order total), revenue_k; undated orders
    belong to no month."""
    g = master.where(F.col("order_purchase_timestamp").isNotNull()).groupBy(month_label("order_purchase_timestamp").alias("month")).agg(
        _zero_sum("total_price").cast("double").alias("revenue"),
        F.count("order_id").alias("orders"),
        _mean("total_price").alias("avg_order"))
    return g.withColumn("revenue_k", F.col("revenue") / 1000).orderBy("month")


def monthly_highlights(master: DataFrame) -> DataFrame:
    """Peak month (earliest on ties) and growth % from the first month to the third-last
    month (null with fewer than three months).  Works on the month aggregate."""
    m = monthly_trend(master)
    by_peak = F.row_number().over(Window.orderBy(F.desc("revenue_k"), F.asc("month")))
    from_start = F.row_number().over(Window.orderBy(F.asc("month")))
    from_end = F.row_number().over(Window.orderBy(F.desc("month")))
    r = m.select("month", "revenue_k", by_peak.alias("p"), from_start.alias("a"), from_end.alias("z"))
    g = r.agg(F.max(F.when(F.col("p") == 1, F.col("month"))).alias("peak_month"),
              F.max(F.when(F.col("p") == 1, F.col("revenue_k"))).alias("peak_revenue_k"),
              F.max(F.when(F.col("a") == 1, F.col("month"))).alias("start_month"),
              F.max(F.when(F.col("a") == 1, F.col("revenue_k"))).alias("start_revenue_k"),
              F.max(F.when(F.col("z") == 3, F.col("month"))).alias("end_month"),
              F.max(F.when(F.col("z") == 3, F.col("revenue_k"))).alias("end_revenue_k"))
    growth = F.try_divide(F.col("end_revenue_k") - F.col("start_revenue_k"), F.col("start_revenue_k")) * 100
    return g.withColumn("growth_pct", growth)


def weekly_revenue(master: DataFrame, windows: Sequence[int] = (4, 8)) -> DataFrame:
    """week (Monday), revenue, ma<k> trailing means over the weeks present (weeks without
    orders are not filled, as in the reference; undated orders belong to no week)."""
    g = master.where(F.col("order_purchase_timestamp").isNotNull()).groupBy(week_start("order_purchase_timestamp").alias("week")).agg(
        _zero_sum("total_price").alias("rev"))
    cols = ["week", F.col("rev").cast("double").alias("revenue")]
    for k in windows:
        w = Window.orderBy("week").rowsBetween(-(k - 1), 0)
        cols.append((F.sum("rev").over(w).cast("double") / F.count("rev").over(w)).alias(f"ma{k}"))
    return g.select(*cols).orderBy("week")


def revenue_forecast(master: DataFrame, horizon: int = 6, step: float = 0.01, band: float = 0.12,
                     window: int = 8) -> DataFrame:
    """Next ``horizon`` weeks: last MA<window> * (1 + step * i), with a +-``band`` range."""
    wk = weekly_revenue(master, (window,))
    last = wk.agg(F.max_by(F.struct("week", f"ma{window}"), F.col("week")).alias("l"))
    i = F.col("i")
    f = F.col("l")[f"ma{window}"] * (F.lit(1.0) + F.lit(float(step)) * i.cast("double"))
    return (last.select("l", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
            .select(i.alias("step"),
                    F.timestamp_add("DAY", i * 7, F.col("l")["week"]).alias("week"),
                    f.alias("forecast"),
                    (f * F.lit(1.0 - band)).alias("low"),
                    (f * F.lit(1.0 + band)).alias("high"))
            .orderBy("step"))


# ---------------------------------------------------------------------------------------
# categories, states, payments, timing
# ---------------------------------------------------------------------------------------

def category_revenue(master: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` English categories by revenue: revenue, orders, avg_rev, avg_score."""
    g = (master.where(F.col("category_english").isNotNull())
         .groupBy("category_english").agg(
             _zero_sum("total_price").cast("double").alias("revenue"),
             F.count("order_id").alias("orders"),
             _mean("total_price").alias("avg_rev"),
             _mean("review_score").alias("avg_score")))
    return g.orderBy(F.desc("revenue"), F.asc("category_english")).limit(k)


def _severity(pct: Column, bands: Sequence[float]) -> Column:
    lo, hi = bands
    return (F.when(pct > hi, F.lit(SEVERITY_LABELS[2])).when(pct > lo, F.lit(SEVERITY_LABELS[1]))
            .otherwise(F.lit(SEVERITY_LABELS[0])))


def state_delivery(master: DataFrame, min_orders: int = 100,
                   bands: Sequence[float] = SEVERITY_BANDS) -> DataFrame:
    """Per customer state with >= ``min_orders`` orders: orders, late_pct, avg_days,
    avg_score, severity (high > 15 %, medium > 10 %, else low)."""
    g = (master.where(F.col("customer_state").isNotNull())
         .groupBy("customer_state").agg(
             F.count("order_id").alias("orders"),
             _mean(F.col("is_late").cast("int")).alias("late_rate"),
             _mean("delivery_days").alias("avg_days"),
             _mean("review_score").alias("avg_score")))
    g = g.withColumn("late_pct", F.col("late_rate") * 100).where(F.col("orders") >= min_orders)
    return (g.select("customer_state", "orders", "late_pct", "avg_days", "avg_score",
                     _severity(F.col("late_pct"), bands).alias("severity"))
            .orderBy("late_pct", "customer_state"))


def state_delivery_mean(master: DataFrame, min_orders: int = 100, digits: int | None = None) -> DataFrame:
    """Unweighted mean of the states' late_pct (the reference line of the state chart)."""
    s = state_delivery(master, min_orders)
    return s.agg(_maybe_round(F.avg("late_pct"), digits).alias("mean_late_pct"),
                 F.count(F.lit(1)).alias("states"))


def payment_share(master: DataFrame) -> DataFrame:
    """Primary payment type, orders, pct of all orders with a payment."""
    g = master.where(F.col("payment_type").isNotNull()).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("orders"))
    # the grouped frame has one row per payment type: the total is a tiny window
    total = F.sum("orders").over(Window.partitionBy())
    return g.select("payment_type", "orders", (F.col("orders") / total * 100).alias("pct")) \
            .orderBy(F.desc("orders"), "payment_type")


def installment_distribution(master: DataFrame, payment_type: str = "credit_card") -> DataFrame:
    """payment_installments, orders for one payment type, by installments."""
    return (master.where((F.col("payment_type") == payment_type) & F.col("payment_installments").isNotNull())
            .groupBy("payment_installments").agg(F.count(F.lit(1)).alias("orders"))
            .orderBy("payment_installments"))


def order_heatmap(master: DataFrame) -> DataFrame:
    """Rows Monday..Sunday, columns h00..h23: orders per purchase weekday and hour (null
    where no order).  Hours are pivoted with explicit values (no distinct pass)."""
    ts = F.col("order_purchase_timestamp")
    counts = (master.groupBy(F.date_format(ts, "EEEE").alias("weekday"), F.hour(ts).alias("hour"))
              .agg(F.count("order_id").alias("c")))
    wide = counts.groupBy("weekday").pivot("hour", list(range(24))).agg(F.first("c"))
    wide = wide.select("weekday", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    days = master.sparkSession.range(1).select(F.posexplode(names).alias("day_index", "weekday"))
    return days.join(wide, "weekday", "left").orderBy("day_index").select(
        "day_index", "weekday", *[f"h{h:02d}" for h in range(24)])


# ---------------------------------------------------------------------------------------
# delivery delay vs review
# ---------------------------------------------------------------------------------------

def _corr_data(master: DataFrame) -> DataFrame:
    return master.select("order_id", "delivery_days", "review_score", "is_late") \
                 .dropna(subset=["delivery_days", "review_score", "is_late"])


def delay_review_corr(master: DataFrame, digits: int | None = None, fit_on: str = "all", k: int = 3000,
                      seed: int = 42) -> DataFrame:
    """Pearson r of delivery_days and review_score over all rows, least-squares slope/intercept of
    review on days, and n.  The line is fitted on all rows, or with ``fit_on="sample"`` on
    those of :func:`delay_review_sample` (the reference's choice)."""
    if fit_on not in ("all", "sample"):
        raise ValueError(f"fit_on is 'all' or 'sample', not {fit_on!r}")
    d = _corr_data(master)
    x, y = F.col("delivery_days").cast("double"), F.col("review_score").cast("double")
    line = F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    out = d.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"), line.alias("line"))
    if fit_on == "sample":
        fit = hash_sample(d, "order_id", k, seed).agg(line.alias("line"))
        out = out.withColumn("line", fit.scalar())
    return out.select(_maybe_round(F.col("r"), digits).alias("r"), _maybe_round(F.col("line.slope"), digits).alias("slope"),
                      _maybe_round(F.col("line.intercept"), digits).alias("intercept"), "n")


def delay_review_sample(master: DataFrame, k: int = 3000, seed: int = 42) -> DataFrame:
    """At most ``k`` rows picked by a seeded hash of order_id (a distributed top-k)."""
    return hash_sample(_corr_data(master), "order_id", k, seed)


def delay_review_trendline(master: DataFrame, k: int = 3000, seed: int = 42, points: int = 100,
                           digits: int | None = None) -> DataFrame:
    """``points`` evenly spaced days over the sample's range with the fitted score (the
    line is fitted on the sample, as the reference does)."""
    s = delay_review_sample(master, k, seed)
    return linear_fit(s, "delivery_days", "review_score", points, digits)


def review_box_stats(master: DataFrame) -> DataFrame:
    """Box-plot numbers of review_score for on-time and late orders."""
    d = _corr_data(master).withColumn(
        "delivery_status", F.when(F.col("is_late"), F.lit("Late")).otherwise(F.lit("On-Time")))
    return box_stats(d, "review_score", ["delivery_status"])


def late_vs_on_time_score(master: DataFrame) -> DataFrame:
    """Mean review score of on-time and late orders (with n)."""
    d = _corr_data(master)
    return (d.groupBy(F.when(F.col("is_late"), F.lit("Late")).otherwise(F.lit("On-Time"))
                      .alias("delivery_status"))
            .agg(F.count(F.lit(1)).alias("n"), _mean("review_score").alias("avg_review_score"))
            .orderBy("delivery_status"))


def late_share_top_states(master: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` states with most late orders and their share of all late orders."""
    late = master.where(F.col("is_late") & F.col("customer_state").isNotNull())
    per_state = late.groupBy("customer_state").agg(F.count(F.lit(1)).alias("late_orders"))
    top = (per_state.orderBy(F.desc("late_orders"), F.asc("customer_state")).limit(k)
           .withColumn("_om_total", master.agg(F.count_if(F.col("is_late"))).scalar()))
    total = F.col("_om_total")
    rank = F.row_number().over(Window.orderBy(F.desc("late_orders"), F.asc("customer_state")))
    everything = Window.partitionBy()
    return (top.select(rank.cast("bigint").alias("rank"), "customer_state", "late_orders",
                       (F.col("late_orders") / total * 100).alias("share_pct"),
                       (F.sum("late_orders").over(everything) / total * 100).alias("top_share_pct"))
            .orderBy("rank"))


def executive_kpis(master: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Eight KPIs in one row (``approx_distinct`` counts sellers/states with HyperLogLog++).

    The two exact distinct counts are scalar subqueries over one column each; counting both beside
    the sums would copy every row per distinct column."""
    def distinct(c: str) -> Column:
        return F.approx_count_distinct(c) if approx_distinct else F.lit(0).cast("bigint")
    out = master.agg(
        _zero_sum("total_price").cast("double").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        _mean("total_price").alias("avg_order_value"),
        (_mean(F.col("is_late").cast("int")) * 100).alias("late_rate_pct"),
        _mean("review_score").alias("avg_review"),
        _mean("delivery_days").alias("avg_delivery_days"),
        distinct("seller_id").alias("active_sellers"),
        distinct("customer_state").alias("states_covered"))
    if approx_distinct:
        return out
    return out.withColumns({name: distinct_count(master, c).scalar()
                            for name, c in (("active_sellers", "seller_id"), ("states_covered", "customer_state"))})


# ---------------------------------------------------------------------------------------
# seller health
# ---------------------------------------------------------------------------------------

def _tier(score: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    if len(labels) != len(cuts) + 1:
        raise ValueError("a label for every cut and one for the rest")
    expr = None
    for cut, label in zip(cuts, labels):
        cond = score >= cut
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    # a null score (no reviews) falls through to the last tier, like NaN in the reference
    return expr.otherwise(F.lit(labels[-1])) if expr is not None else F.lit(labels[-1])


def seller_health(master: DataFrame, weights: Sequence[float] = (40, 40, 20),
                  cuts: Sequence[float] = TIER_CUTS, labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """Per primary seller: orders, revenue, avg_score, late_rate, avg_delivery, the three
    part scores, health_score (0-100) and tier.  Volume is orders / max orders.  ``labels`` names
    the tiers from the highest cut down, the last one being the rest."""
    w1, w2, w3 = (float(x) for x in weights)
    s = (master.where(F.col("seller_id").isNotNull())
         .groupBy("seller_id").agg(
             F.count("order_id").alias("orders"),
             _zero_sum("total_price").cast("double").alias("revenue"),
             _mean("review_score").alias("avg_score"),
             _mean(F.col("is_late").cast("int")).alias("late_rate"),
             _mean("delivery_days").alias("avg_delivery")))
    # the seller-grain stats feed the max-orders scalar and the scores: aggregate once
    s = materialize(s)
    max_orders = s.agg(F.max("orders")).scalar()
    s = (s.withColumn("score_review", F.col("avg_score") / 5 * w1)
          .withColumn("score_ontime", (1 - F.col("late_rate")) * w2)
          .withColumn("score_volume", F.col("orders") / max_orders * w3))
    total = F.col("score_review") + F.col("score_ontime") + F.col("score_volume")
    s = s.withColumn("health_score", F.when(total.isNull(), F.lit(None))
                     .otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))))
    return s.withColumn("tier", _tier(F.col("health_score"), cuts, labels))


def seller_health_histogram(master: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of the health scores (all ``bins`` bins, empty ones 0)."""
    return health_histogram(seller_health(master), bins)


def health_histogram(health: DataFrame, bins: int = 30) -> DataFrame:
    """The histogram from an already computed :func:`seller_health` frame."""
    return histogram(health, "health_score", bins)


def seller_tiers(master: DataFrame, cuts: Sequence[float] = TIER_CUTS,
                 labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """tier, sellers in the fixed tier order; tiers without sellers are left out."""
    return tier_counts(seller_health(master, cuts=cuts, labels=labels), labels)


def tier_counts(h: DataFrame, labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """Tier counts from an already computed :func:`seller_health` frame."""
    order = F.when(F.col("tier") == labels[0], 1)
    for i, label in enumerate(labels[1:], start=2):
        order = order.when(F.col("tier") == label, i)
    return (h.groupBy("tier").agg(F.count(F.lit(1)).alias("sellers"))
            .select(order.alias("tier_order"), "tier", "sellers").orderBy("tier_order"))


# ---------------------------------------------------------------------------------------
# RFM segments (quartile version)
# ---------------------------------------------------------------------------------------

def _qcut_bins(x: Column, edges: Column, labels: Sequence[int]) -> Column:
    """Right-closed bins over the inner quantile edges (the lowest value is included);
    a null value has no bin."""
    q = len(labels)
    expr = F.when(x.isNull(), F.lit(None)).when(le_quantile(x, edges["q1"]), labels[0])
    for i in range(2, q):
        expr = expr.when(le_quantile(x, edges[f"q{i}"]), labels[i - 1])
    return expr.otherwise(labels[q - 1]).cast("int")


def _edge_check(edges: Column, name: str, on_duplicate: str, q: int = 4) -> Column:
    """Error when two consecutive quantile edges coincide (pandas ``qcut`` raises)."""
    if on_duplicate != "error":
        return F.lit(True)

    def num(e):  # edge * den, exactly
        return e["lo"] * e["den"] + (e["hi"] - e["lo"]) * e["rem"]

    dup = None
    for i in range(q):
        ea, eb = edges[f"q{i}"], edges[f"q{i + 1}"]
        c = num(ea) * eb["den"] == num(eb) * ea["den"]
        dup = c if dup is None else (dup | c)
    return F.when(dup, F.raise_error(F.lit(f"qcut: duplicate bin edges for {name}"))).otherwise(F.lit(True))


def qcut(df: DataFrame, col: str, name: str, reverse: bool = False,
         on_duplicate_edges: str = "error", q: int = 4, approx: bool = False, edges: Column | None = None) -> DataFrame:
    """pandas ``qcut(col, q)`` with labels 1..q (q..1 with ``reverse``) and exact edges.
    ``on_duplicate_edges="error"`` fails like pandas when edges repeat; any other value
    bins anyway (a repeated edge leaves its bin empty).  ``approx=True`` takes the edges
    from ``percentile_approx`` (one pass, bounded memory, edges are data values); ``edges`` hands
    in known ones (a struct of the structs ``q0`` to ``q<q>`` of ``exact_quantiles``)."""
    probs = [i / q for i in range(q + 1)]
    if edges is None:
        if approx:
            pa = F.percentile_approx(F.col(col), probs, 10000)
            one = F.lit(1).cast("bigint")
            table = df.agg(*[F.struct(pa[i].alias("lo"), pa[i].alias("hi"), F.lit(0).cast("bigint").alias("rem"),
                                      one.alias("den")).alias(f"q{i}") for i in range(q + 1)])
        else:
            table = exact_quantiles(df, col, probs)
        # one scalar subquery, attached once as a column and then referenced by name
        edges = table.select(F.struct(*[F.col(f"q{i}").alias(f"q{i}") for i in range(q + 1)])).scalar()
    labels = list(range(q, 0, -1)) if reverse else list(range(1, q + 1))
    e = F.col("_om_edges")
    ok = _edge_check(e, col, on_duplicate_edges, q)
    return (df.withColumn("_om_edges", edges)
            .withColumn(name, F.when(ok, _qcut_bins(F.col(col), e, labels))).drop("_om_edges"))


def rfm_segments(master: DataFrame, customer: str = "customer_id", on_duplicate_edges: str = "error",
                 snapshot: str | None = None, approx: bool = False) -> DataFrame:
    """Per customer: recency (whole days from the last order to ``snapshot``, by default
    the last purchase + 1 day), frequency, monetary, quartile scores R (reversed),
    F (on first-come ranks), M, their sum, the F/M mean and the segment.  ``approx``
    takes the R and M quartile edges from ``percentile_approx``."""
    ts = F.col("order_purchase_timestamp")
    if snapshot is None:
        snap = F.timestamp_add("DAY", F.lit(1), master.agg(F.max(ts)).scalar())
    else:
        snap = F.to_timestamp_ntz(F.lit(snapshot))
    rfm = (master.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.max(ts).alias("_last"),
        F.count("order_id").alias("frequency"),
        _zero_sum("total_price").alias("monetary")))
    # written once; the quartile edges of both values and the borders of the frequency ranks are
    # found by the same counting passes over it, and the scores are comparisons with them
    rfm = materialize(rfm.select(customer, floor_days(F.col("_last"), snap).alias("recency"), "frequency",
                                 "monetary"), columnar=True)
    by_frequency = [("frequency", True), (customer, True)]
    # F: qcut over rank(method="first") = 1..n, whose quartile edges are 1 + (n - 1) * i / 4; the
    # border of a score is the last rank that is not above its edge
    borders = lambda n: sorted({(n - 1) * i // 4 for i in (1, 2, 3)} - {n - 1})
    valued = [] if approx else ["recency", "monetary"]
    probs = [i / 4 for i in range(5)]
    quartiles = lambda n: [at for q in quantile_places(probs, n) for at in q[:2]]
    *edges, (n, ranks) = select_ranks(rfm, [[(c, True)] for c in valued] + [by_frequency],
                                      [quartiles] * len(valued) + [borders], known=True)[()]
    if on_duplicate_edges == "error" and 0 < n < 4:
        raise ValueError("qcut: duplicate bin edges for frequency")
    of = {c: quantile_structs(rfm, c, probs, *e) for c, e in zip(valued, edges)}
    rfm = qcut(rfm, "recency", "r_score", reverse=True, on_duplicate_edges=on_duplicate_edges, approx=approx,
               edges=of.get("recency"))
    rfm = qcut(rfm, "monetary", "m_score", on_duplicate_edges=on_duplicate_edges, approx=approx, edges=of.get("monetary"))
    rfm = rfm.withColumn("f_score", steps(rfm, by_frequency, ranks).cast("int"))
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    fm = (F.col("f_score") + F.col("m_score")) / 2
    rfm = rfm.withColumn("rfm_score", total).withColumn("fm_avg", fm)
    segment = rfm_segment_expr(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return rfm.select(customer, "recency", "frequency", "monetary",
                      "r_score", "f_score", "m_score", "rfm_score", "fm_avg", segment.alias("segment"))


def rfm_segment_expr(r: Column, f: Column, m: Column) -> Column:
    """Segment of an (R, F, M) score triple, rules checked top-down."""
    total, fm = r + f + m, (f + m) / 2
    # a customer without a score (no dated order) has no segment
    return (F.when(total.isNull(), F.lit(None)).when(total >= 10, SEGMENTS[0]).when(total >= 8, SEGMENTS[1])
            .when((r >= 3) & (fm >= 2), SEGMENTS[2]).when((r == 4) & (fm < 2), SEGMENTS[3])
            .when((r <= 2) & (fm >= 3), SEGMENTS[4]).otherwise(SEGMENTS[5]))


def rfm_segment_summary(master: DataFrame, customer: str = "customer_id", snapshot: str | None = None) -> DataFrame:
    """segment, customers, avg_monetary."""
    return segment_summary(rfm_segments(master, customer, snapshot=snapshot), customer)


def segment_summary(r: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The summary from an already computed :func:`rfm_segments` frame."""
    return (r.groupBy("segment").agg(F.count(customer).alias("customers"),
                                     _mean("monetary").alias("avg_monetary"))
            .orderBy(F.desc("customers"), "segment"))
