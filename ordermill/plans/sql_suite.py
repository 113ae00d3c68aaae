"""The ten SQL analyses over the raw role tables, as DataFrame plans.

Semantics follow the SQL text (inner joins drop unmatched rows, ``LEFT JOIN reviews``
repeats rows per review, ``ROUND`` is half away from zero on exact values).  Rounded
outputs are computed exactly (``ordermill.functions.exact``) and returned as DOUBLE.
Every ORDER BY ends with the entity id so LIMIT and NTILE are deterministic.

Scale notes per query are in the docstrings; the common pattern is "aggregate to the join
key first, then join 1:1", which keeps hot keys inside map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordermill.functions.exact import (WIDE, cents, cents_avg, cents_to_double, from_cents, half_up_div,
                                       money_avg, ratio_round, to_cents)
from ordermill.functions.labels import LATE_LABEL, ON_TIME_LABEL
from ordermill.functions.time import month_label, weekday_name
from ordermill.operators.picks import order_review
from ordermill.operators.ranking import global_ntile, ntiles, ranked
from ordermill.operators.reviews import fan_out_weight, latest_review_weights, review_weights
from ordermill.session import materialize

DELIVERED = "delivered"


def _delivered(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.where(F.col("order_status") == status)


def _late_flag() -> "F.Column":
    # CASE WHEN delivered > estimated THEN 1 ELSE 0 END: a null comparison counts 0
    return F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1) \
            .otherwise(0)


def _items_per_order(items: DataFrame) -> DataFrame:
    """order_id, it_cents (sum of price in cents), it_n (non-null prices), it_freight_cents."""
    return items.groupBy("order_id").agg(
        F.sum(to_cents(F.col("price"))).alias("it_cents"), F.count("price").alias("it_n"),
        F.sum(to_cents(F.col("freight_value"))).alias("it_freight_cents"))


def monthly_trend_sql(orders: DataFrame, items: DataFrame, status: str = DELIVERED,
                      approx_distinct: bool = False) -> DataFrame:
    """Q1: month, total_orders, total_revenue, avg_order_value (mean *item* price), total_freight.

    Items are summed per order before the join, so the join and the month aggregate see
    one row per order instead of one per item."""
    o = _delivered(orders, status).select("order_id", month_label("order_purchase_timestamp").alias("month"))
    j = o.join(_items_per_order(items), "order_id")
    distinct = F.approx_count_distinct if approx_distinct else F.count_distinct
    g = j.groupBy("month").agg(
        distinct("order_id").alias("total_orders"),
        F.sum("it_cents").alias("s"), F.sum("it_n").alias("n"), F.sum("it_freight_cents").alias("f"))
    return g.select("month", "total_orders", cents_to_double(F.col("s")).alias("total_revenue"),
                    cents_avg(F.col("s"), F.col("n")).alias("avg_order_value"),
                    cents_to_double(F.col("f")).alias("total_freight")).orderBy("month")


def top_categories(items: DataFrame, products: DataFrame, translation: DataFrame,
                   reviews: DataFrame, k: int = 10, review_policy: str = "all",
                   review_order: tuple[str, ...] = ("review_creation_date",)) -> DataFrame:
    """Q2: top ``k`` English categories by revenue, with the review fan-out of
    ``LEFT JOIN order_reviews`` (``review_policy="all"``) or one latest review per order
    (``"latest"``).  No status filter, as in the SQL."""
    if review_policy == "all":
        rv = review_weights(reviews)
    elif review_policy == "latest":
        rv = latest_review_weights(order_review(reviews, review_order))
    else:
        raise ValueError(f"unknown review_policy {review_policy!r}")
    # one row per (order, category) first: the distinct order count becomes a plain count
    # and the review join sees pairs instead of item rows.  With m item rows of an order
    # in a category, the SQL's LEFT JOIN repeats each of them once per review row, so the
    # pair contributes (price sum) * w to revenue and m * (review sum/count) to the mean.
    pairs = (items.select("order_id", "product_id", "price")
             .join(products.select("product_id", "product_category_name"), "product_id")
             .join(translation, "product_category_name")
             .groupBy("order_id", F.col("product_category_name_english").alias("category"))
             .agg(F.sum(to_cents(F.col("price"))).alias("p_cents"), F.count("price").alias("p_n"),
                  F.count(F.lit(1)).alias("m")))
    w = fan_out_weight()
    j = pairs.join(rv, "order_id", "left")
    g = j.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("p_cents") * w).alias("s"),
        F.sum(F.col("p_n") * w).alias("n"),
        F.sum(F.col("m") * F.col("rv_sum")).alias("rs"), F.sum(F.col("m") * F.col("rv_n")).alias("rn"))
    return (g.select("category", "orders", cents_to_double(F.col("s")).alias("revenue"),
                     cents_avg(F.col("s"), F.col("n")).alias("avg_price"),
                     ratio_round(F.col("rs"), F.col("rn"), 2).alias("avg_review_score"))
            .orderBy(F.desc_nulls_last("revenue"), F.asc("category")).limit(k))


def late_by_state(orders: DataFrame, customers: DataFrame, min_orders: int = 100,
                  status: str = DELIVERED) -> DataFrame:
    """Q3: per customer state with at least ``min_orders`` dated deliveries: orders,
    late orders, late rate %, mean calendar days purchase -> delivery.

    Orders are reduced to one row per customer before joining the customers."""
    o = _delivered(orders, status).where(F.col("order_delivered_customer_date").isNotNull())
    days = F.datediff(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    per_cust = o.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum(_late_flag()).alias("l"),
        F.sum(days).alias("d"), F.count(days).alias("dn"))
    g = (per_cust.join(customers.select("customer_id", "customer_state"), "customer_id")
         .groupBy("customer_state")
         .agg(F.sum("c").alias("total_orders"), F.sum("l").alias("late_orders"),
              F.sum("d").alias("d"), F.sum("dn").alias("dn"))
         .where(F.col("total_orders") >= min_orders))
    return (g.select("customer_state", "total_orders", "late_orders",
                     ratio_round(F.col("late_orders") * 100, F.col("total_orders"), 2).alias("late_rate_pct"),
                     ratio_round(F.col("d"), F.col("dn"), 1).alias("avg_delivery_days"))
            .orderBy(F.desc_nulls_last("late_rate_pct"), F.asc("customer_state")))


def review_by_timeliness(orders: DataFrame, reviews: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Q4: 'Late' / 'On Time': orders x reviews rows, mean score (3 digits), 5-star and
    <=2-star counts.  Reviews are aggregated per order, then joined 1:1."""
    o = _delivered(orders, status).where(F.col("order_delivered_customer_date").isNotNull())
    label = F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
                   F.lit(LATE_LABEL)).otherwise(F.lit(ON_TIME_LABEL))
    j = o.select("order_id", label.alias("delivery_status")).join(review_weights(reviews), "order_id")
    g = j.groupBy("delivery_status").agg(
        F.sum("rv_rows").alias("orders"), F.sum("rv_sum").alias("rs"), F.sum("rv_n").alias("rn"),
        F.sum("rv_five").alias("five_star_count"), F.sum("rv_low").alias("low_score_count"))
    return g.select("delivery_status", "orders", ratio_round(F.col("rs"), F.col("rn"), 3).alias("avg_review_score"),
                    "five_star_count", "low_score_count").orderBy("delivery_status")


def seller_health_items(sellers: DataFrame, items: DataFrame, orders: DataFrame, reviews: DataFrame,
                        weights: tuple[int, int, int] = (40, 40, 20), volume_cap: int = 500,
                        min_orders: int = 10, k: int = 20, status: str = DELIVERED) -> DataFrame:
    """Q5: seller ranking by the composite health score
    ``avg_review/5*w1 + (1 - late/rows)*w2 + min(orders/cap, 1)*w3`` over the fan-out rows
    of sellers x items x orders LEFT JOIN reviews; sellers with at least ``min_orders``.

    Everything is aggregated to seller grain before the sellers join; the score is
    rounded exactly as a rational number (integer weights)."""
    w1, w2, w3 = (int(x) for x in weights)
    o = _delivered(orders, status).select("order_id", _late_flag().alias("late"))
    # one row per (order, seller) first; with m item rows of the order for the seller and
    # o_n matching order rows, the SQL's joins produce m * o_n * w rows for the pair
    pairs = (items.select("order_id", "seller_id", "price")
             .groupBy("order_id", "seller_id")
             .agg(F.sum(to_cents(F.col("price"))).alias("p_cents"), F.count(F.lit(1)).alias("m")))
    per_order = o.groupBy("order_id").agg(F.count(F.lit(1)).alias("o_n"), F.sum("late").alias("o_late"))
    w = fan_out_weight()
    j = pairs.join(per_order, "order_id").join(review_weights(reviews), "order_id", "left")
    per_seller = j.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.col("p_cents") * F.col("o_n") * w).alias("s"),
        F.sum(F.col("m") * F.col("o_n") * F.coalesce(F.col("rv_sum"), F.lit(0))).alias("rs"),
        F.sum(F.col("m") * F.col("o_n") * F.coalesce(F.col("rv_n"), F.lit(0))).alias("rn"),
        F.sum(F.col("m") * F.col("o_n") * w).alias("rows"),
        F.sum(F.col("m") * F.col("o_late") * w).alias("late"))
    # a seller row that is there several times multiplies the joined rows: one row and its weight
    # (means and rates do not change, sums do)
    g = (per_seller.where(F.col("total_orders") >= min_orders)
         .join(sellers.groupBy("seller_id", "seller_state").agg(F.count(F.lit(1)).alias("times")), "seller_id"))
    rs, rn, rows, late, d = (F.col(c).cast(WIDE) for c in ("rs", "rn", "rows", "late", "total_orders"))
    capped = F.least(d, F.lit(volume_cap).cast(WIDE))
    den = rn * rows * 5 * volume_cap
    num = (w1 * rs * rows * volume_cap + w2 * (rows - late) * rn * 5 * volume_cap
           + w3 * capped * rn * rows * 5)
    health = (half_up_div(num * 10, den).cast("double") / 10)
    return (g.select("seller_id", "seller_state", "total_orders",
                     cents_to_double(F.col("s") * F.col("times")).alias("total_revenue"),
                     ratio_round(F.col("rs"), F.col("rn"), 2).alias("avg_review"),
                     ratio_round(F.col("late") * 100, F.col("rows"), 2).alias("late_rate_pct"),
                     health.alias("health_score"))
            .orderBy(F.desc_nulls_last("health_score"), F.asc("seller_id")).limit(k))


def payment_breakdown(payments: DataFrame, orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Q6: per payment type over delivered orders: transactions, value, mean value,
    mean installments."""
    j = payments.join(_delivered(orders, status).select("order_id"), "order_id")
    g = j.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("payment_value").alias("s"),
        F.count("payment_value").alias("n"), F.sum("payment_installments").alias("si"),
        F.count("payment_installments").alias("ni"))
    return (g.select("payment_type", "transactions", F.col("s").cast("double").alias("total_value"),
                     money_avg(F.col("s"), F.col("n")).alias("avg_value"),
                     ratio_round(F.col("si"), F.col("ni"), 1).alias("avg_installments"))
            .orderBy(F.desc_nulls_last("total_value"), F.asc("payment_type")))


def peak_times(orders: DataFrame, k: int = 20, status: str = DELIVERED) -> DataFrame:
    """Q7: the ``k`` busiest (weekday, hour) cells of delivered orders."""
    ts = F.col("order_purchase_timestamp")
    g = (_delivered(orders, status)
         .groupBy(weekday_name(ts).alias("day_name"), F.hour(ts).alias("hour_of_day"))
         .agg(F.count(F.lit(1)).alias("order_count")))
    return g.orderBy(F.desc("order_count"), "day_name", "hour_of_day").limit(k)


def seller_revenue(sellers: DataFrame, items: DataFrame, orders: DataFrame,
                   status: str = DELIVERED) -> DataFrame:
    """Revenue of delivered orders per seller (aggregated before the sellers join, whose side is
    one row per seller with the number of its rows, by which the SQL's join multiplies)."""
    o = _delivered(orders, status).select("order_id")
    per_seller = (items.select("order_id", "seller_id", "price").join(o, "order_id")
                  .groupBy("seller_id").agg(F.sum(to_cents(F.col("price"))).alias("cents")))
    weights = sellers.groupBy("seller_id").agg(F.count(F.lit(1)).alias("times"))
    return per_seller.join(weights, "seller_id").select(
        "seller_id", from_cents(F.col("cents") * F.col("times")).alias("revenue"))


def pareto(seller_rev: DataFrame, top_n: int | None = 20, entity: str = "seller_id",
           value: str = "revenue", top_pct: float | None = None) -> DataFrame:
    """Q8: rank, entity, value, % of entities, cumulative % of value for ranks <= top_n.

    ``ROW_NUMBER`` orders by value desc then entity; the cumulative sum uses SQL's
    default RANGE frame, so tied values share it.  Only the first ``top_n`` rows are
    needed, so the plan is a distributed top-k (``TakeOrderedAndProject``) plus global
    aggregates: the running sum at a top-k value ``v`` is the sum of all values >= v,
    which is the top-k rows above it plus every tie of the smallest kept value.  All
    frames after the top-k have at most ``top_n + 1`` rows.  The input is read three
    times (top-k, totals, ties): pass a materialised frame if it is expensive.

    With ``top_pct`` the rows kept are those with ``100 * rnk / n <= top_pct``, which
    can be a large share of all entities: every entity is then ranked with the
    distributed ranking, and the RANGE running sum comes from prefix sums over the
    distinct values (in cents), joined back by value."""
    if top_pct is not None or top_n is None:
        return _pareto_pct(seller_rev, 100.0 if top_pct is None else top_pct, entity, value)
    ranked_top = seller_rev.orderBy(F.desc(value), F.asc(entity)).limit(top_n)
    totals = seller_rev.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("tot"))
    floor_value = ranked_top.agg(F.min(value)).scalar()
    # distinct values >= the smallest kept value: at most top_n of them, and null, which
    # sorts last, adds nothing and stays in the result
    last = seller_rev.agg(F.count(value)).scalar() < top_n
    by_value = (seller_rev.where((F.col(value) >= floor_value) | (F.col(value).isNull() & last))
                .groupBy(value).agg(F.sum(value).alias("v_sum")))
    cum = by_value.select(value, F.sum("v_sum").over(
        Window.orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, 0)).alias("cum"))
    rnk = F.row_number().over(Window.orderBy(F.desc(value), F.asc(entity))).cast("bigint")
    t = F.col("_om_t")
    cum = cum.withColumnRenamed(value, "_om_v")
    return (ranked_top.join(cum, F.col(value).eqNullSafe(F.col("_om_v"))).withColumn("_om_t", totals.select(F.struct("n", "tot")).scalar())
            .select(rnk.alias("rnk"), entity, F.col(value).cast("double").alias(value),
                    ratio_round(rnk * 100, t["n"], 1).alias("pct_of_sellers"),
                    ratio_round(cents(F.col("cum")) * 100, cents(t["tot"]), 1).alias("pct_of_revenue"))
            .orderBy("rnk"))


def _pareto_pct(seller_rev: DataFrame, top_pct: float, entity: str, value: str) -> DataFrame:
    r = ranked(seller_rev.select(entity, value), [(value, False), (entity, True)], rank_col="rnk", total_col="n")
    by_value = seller_rev.groupBy(value).agg(F.coalesce(F.sum(cents(F.col(value))), F.lit(0)).cast("bigint").alias("v_cents"))
    cum = ranked(by_value, [(value, False)], rank_col="_om_vr", sum_cols=["v_cents"],
                 total_sum_col="tot_cents").select(F.col(value).alias("_om_v"), "cum_v_cents", "tot_cents")
    kept = r.where(F.col("rnk") * 100 <= F.lit(float(top_pct)) * F.col("n"))
    return (kept.join(cum, F.col(value).eqNullSafe(F.col("_om_v")))
            .select(F.col("rnk").cast("bigint").alias("rnk"), entity, F.col(value).cast("double").alias(value),
                    ratio_round(F.col("rnk") * 100, F.col("n"), 1).alias("pct_of_sellers"),
                    ratio_round(F.col("cum_v_cents") * 100, F.col("tot_cents"), 1).alias("pct_of_revenue"))
            .orderBy("rnk"))


def pareto_sellers(sellers: DataFrame, items: DataFrame, orders: DataFrame, top_n: int | None = 20,
                   status: str = DELIVERED, top_pct: float | None = None) -> DataFrame:
    # the seller-grain revenue is read by the top-k, the totals and the tie count
    return pareto(materialize(seller_revenue(sellers, items, orders, status)), top_n=top_n, top_pct=top_pct)


def period_growth(df: DataFrame, period: str, value: str, window: int = 3) -> DataFrame:
    """Per period (one row each, ordered by ``period``): value, previous value, growth %
    (1 digit, null after a zero) and the trailing ``window``-period mean (2 digits).

    ``df`` is already aggregated to one row per period (months or weeks: a bounded
    frame), so the unpartitioned windows here stay small."""
    by_period = Window.orderBy(period)
    trail = by_period.rowsBetween(-(window - 1), 0)
    prev = F.lag(value).over(by_period)
    growth = ratio_round(cents(F.col(value) - prev) * 100, F.nullif(cents(prev), F.lit(0).cast(WIDE)), 1)
    return df.select(
        period, F.col(value).cast("double").alias("revenue"),
        prev.cast("double").alias("prev_month_revenue"),
        growth.alias("mom_growth_pct"),
        money_avg(F.sum(value).over(trail), F.count(value).over(trail)).alias(f"rolling_{window}m_avg"),
    ).orderBy(period)


def mom_growth(orders: DataFrame, items: DataFrame, window: int = 3, status: str = DELIVERED) -> DataFrame:
    """Q9: month, revenue, previous month, growth % and trailing ``window``-month mean."""
    o = _delivered(orders, status).select("order_id", month_label("order_purchase_timestamp").alias("month"))
    m = (o.join(_items_per_order(items), "order_id").groupBy("month")
         .agg(from_cents(F.sum("it_cents")).alias("rev")))
    return period_growth(m, "month", "rev", window)


def rfm_ntile(customers: DataFrame, orders: DataFrame, items: DataFrame,
              snapshot: str = "2018-12-01", n: int = 4, k: int = 50,
              status: str = DELIVERED, method: str = "select") -> DataFrame:
    """Q10: per unique customer: recency (calendar days to ``snapshot``), frequency,
    monetary, NTILE(n) scores and their total; the top ``k`` by total.

    The three NTILEs are global orders over all customers (ties broken by customer_unique_id).
    The customer aggregate is written once; its tile borders are found together by counting passes
    and every customer is scored by comparison with them.  ``method`` is that of
    :func:`ordermill.operators.ranking.global_ntile`."""
    o = _delivered(orders, status).select("order_id", "customer_id", "order_purchase_timestamp")
    j = (o.join(_items_per_order(items).select("order_id", "it_cents"), "order_id")
         .join(customers.select("customer_id", "customer_unique_id"), "customer_id"))
    raw = j.groupBy("customer_unique_id").agg(
        F.datediff(F.to_date(F.lit(snapshot)), F.max("order_purchase_timestamp")).alias("recency_days"),
        F.count_distinct("order_id").alias("frequency"),
        F.sum("it_cents").alias("monetary_cents"))
    # cents order exactly like the money amounts; converted back once per customer
    raw = raw.select("customer_unique_id", "recency_days", "frequency", from_cents(F.col("monetary_cents")).alias("monetary"))
    cid = ("customer_unique_id", True)
    orders = {"R_score": [("recency_days", False), cid], "F_score": [("frequency", True), cid],
              "M_score": [("monetary", True), cid]}
    if method == "select":
        s = ntiles(materialize(raw, columnar=True), n, orders)
    else:
        s = raw
        for name, order in orders.items():
            s = global_ntile(s, n, order, name, method=method)
    total = F.col("R_score") + F.col("F_score") + F.col("M_score")
    return (s.select("customer_unique_id", F.col("recency_days").cast("bigint").alias("recency_days"),
                     "frequency", F.col("monetary").cast("double").alias("monetary"),
                     "R_score", "F_score", "M_score", total.alias("rfm_total"))
            .orderBy(F.desc("rfm_total"), F.asc("customer_unique_id")).limit(k))
