"""Stored products: clustered joins, invalidation, one write per frame; per-key picks without sort aggregates."""

import os
import random
import shutil
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from om_paths import SF_SMALL
from ordermill.operators import picks
from ordermill.operators.stats import box_stats, distinct_count, hash_sample, sample_key
from ordermill.plans import analyses as A
from ordermill.plans import registry
from ordermill.session import materialize


def final_plan(df):
    """The plan after all adaptive steps of a full run."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan")[0]


def test_master_joins_stored_parts_without_an_order_id_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to be sent
    try:
        p = registry.master_plan(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert p.count("SortMergeJoin [order_id") == 3
    assert "hashpartitioning(order_id" not in p and "hashpartitioning(customer_id" in p
    assert p.count("Bucketed: true") >= 4


def test_bucketed_frames_are_whole_and_typed(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("order_id"), F.lit("x").alias("s"), F.lit(None).cast("decimal(12,2)").alias("m"))
    df = df.union(spark.sql("SELECT CAST(NULL AS BIGINT), NULL, 1.50"))
    back = materialize(df, bucket_by=("order_id",))
    assert back.dtypes == df.dtypes and back.exceptAll(df).count() == 0 == df.exceptAll(back).count()
    assert materialize(df.limit(0), bucket_by=("order_id",)).count() == 0


def test_changed_files_build_products_anew(spark):
    folder = tempfile.mkdtemp(prefix="om-listing-")
    for name in os.listdir(SF_SMALL):
        shutil.copy(f"{SF_SMALL}/{name}", folder)
    query = registry.queries()
    before = query["delivery_summary"](spark, folder).first()
    assert query["delivery_summary"](spark, folder).first() == before
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    orders["o_orderdate"] = orders["o_orderdate"].astype("datetime64[us]")
    orders.to_parquet(f"{folder}/orders.parquet")
    after = query["delivery_summary"](spark, folder).first()
    assert 0 < after.delivered < before.delivered
    raw = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert {r.table: r.row_count for r in query["profile_tables"](spark, folder).collect()}["orders"] == raw
    assert query["master"](spark, folder).count() == after.delivered


def test_unchanged_files_keep_the_product(spark):
    assert registry._master(spark, SF_SMALL) is registry._master(spark, SF_SMALL)


@pytest.fixture(scope="module")
def reviews(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(2000):
        order = 1 if k % 3 == 0 else rnd.randint(2, 900) if k % 50 else None  # a third of all rows share one key
        rows.append((order, rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice([None, datetime(2018, 1, rnd.randint(1, 5))]),
                     f"title {k}", "text " * 50))
    schema = "order_id long, review_score int, review_creation_date timestamp_ntz, review_comment_title string, review_comment_message string"
    return rows, spark.createDataFrame(rows, schema).repartition(7)


def test_latest_review_by_hand_and_without_texts(reviews):
    rows, df = reviews
    got = {r.order_id: r.review_score for r in picks.order_review(df).collect()}
    want = {}
    for order, score, when, *_ in rows:
        key = (when is not None, when or datetime(1, 1, 1), score is not None, score or 0)
        if order not in want or key > want[order][0]:
            want[order] = (key, score)
    assert got == {o: s for o, (_, s) in want.items()}
    p = final_plan(picks.order_review(df))
    assert "review_comment" not in p[p.index("Exchange hashpartitioning(order_id"):].split("Exchange REPARTITION")[0].split("RoundRobin")[0]


@pytest.mark.parametrize("pick", ["dedup", "order_seller", "order_payment", "order_review"])
def test_no_sort_aggregate_and_one_row_per_key_before_the_shuffle(spark, reviews, pick):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("order_id"),
                                   (F.col("id") % 4).cast("int").alias("order_item_id"), F.concat(F.lit("s"), "id").alias("seller_id"),
                                   F.lit(1).cast("decimal(12,2)").alias("payment_value"), F.lit("boleto").alias("payment_type"),
                                   F.lit(1).alias("payment_installments"))
    df = {"dedup": lambda: picks.dedup(hot, ["order_id"]), "order_seller": lambda: picks.order_seller(hot),
          "order_payment": lambda: picks.order_payment(hot), "order_review": lambda: picks.order_review(reviews[1])}[pick]()
    p = final_plan(df)
    assert "SortAggregate" not in p and p.count("WindowGroupLimit") == 2 and "Partial" in p


def test_dedup_on_all_columns_and_on_hot_keys(spark):
    rnd = random.Random(1)
    rows = [(1 if k % 3 == 0 else rnd.randint(2, 300), rnd.choice(["a", None, "b"]), rnd.randint(0, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, v long")
    got = {r.k: (r.s, r.v) for r in picks.dedup(df, ["k"]).collect()}
    want = {}
    for k, s, v in rows:
        key = (s is not None, s or "", v)
        if k not in want or key < want[k]:
            want[k] = key
    assert got == {k: (x[1] if x[0] else None, x[2]) for k, x in want.items()}
    assert picks.dedup(df, ["k", "s", "v"]).count() == len(set(rows))
    by = {r.k: r.v for r in picks.dedup(df, ["k"], ["v"]).collect()}
    assert by == {k: min(v for kk, _, v in rows if kk == k) for k in by}


def test_orders_without_seller_stay(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 2, "a"), (2, 1, None)], "order_id long, order_item_id int, seller_id string")
    assert {tuple(r) for r in picks.order_seller(df).collect()} == {(1, "a"), (2, None)}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_distinct_counts(spark, kind):
    rnd = random.Random(6)
    ids = [rnd.choice([None, 0, -1, -40000, 32768, 32769, 2**31 - 1, rnd.randint(-10**6, 10**6)]) for _ in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select(F.col("i").cast(kind))
    assert distinct_count(df, "i").first().n == len({i for i in ids if i is not None})
    assert distinct_count(df.limit(0), "i").first().n == 0


def test_kpis_copy_no_rows(spark):
    m = registry.queries()["master"](spark, SF_SMALL)
    kpis = A.executive_kpis(m)
    assert "Expand" not in kpis._jdf.queryExecution().optimizedPlan().toString()
    row = kpis.first()
    assert row.active_sellers == m.select("seller_id").dropna().distinct().count()
    assert row.states_covered == m.select("customer_state").dropna().distinct().count()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sample_passes_hardly_more_than_it_keeps(spark, kind):
    n, k = 200_000, 500
    df = spark.range(n).select(F.col("id").cast(kind).alias("id"), (F.col("id") % 7).alias("x"))
    sample = hash_sample(df, "id", k)
    p = final_plan(sample)
    assert "TakeOrderedAndProject" in p and sample.count() == k
    h = sample_key(F.col("id"), df.schema["id"].dataType, 42)
    cls = F.floor(F.log2(h.cast("double") + 1) * 16)
    last = df.select(h.alias("h"), cls.alias("c")).orderBy("h").limit(k).agg(F.max("c")).first()[0]
    assert k <= df.where(cls <= last).count() <= 1.3 * k
    assert df.groupBy(cls).count().count() <= 63 * 16


def test_sample_of_few_rows_nulls_and_one_hot_key(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (3, 1), (None, None), (4, 0)], "id long, x long")
    assert hash_sample(df, "id", 10).count() == 5
    assert sorted(r.id for r in hash_sample(df, "id", 3).collect()) == [3, 3, 4]
    assert hash_sample(df.limit(0), "id", 10).count() == 0
    hot = spark.range(5000).select(F.lit(9).cast("bigint").alias("id"), F.col("id").alias("x"))
    assert sorted(r.x for r in hash_sample(hot, "id", 4).collect()) == [0, 1, 2, 3]


def test_box_counts_are_written_once(spark, monkeypatch):
    from ordermill.operators import stats
    written = []
    monkeypatch.setattr(stats, "materialize", lambda df, columnar=False: (written.append(df.columns), materialize(df, columnar))[1])
    box_stats(spark.createDataFrame([("a", 1), ("a", 2)], "g string, v long"), "v", ["g"]).collect()
    assert written == [["g", "v", "_om_c"]]


def test_line_fitted_on_all_rows_or_the_sample(spark):
    m = registry.queries()["master"](spark, SF_SMALL)
    everything, sample = A.delay_review_corr(m).first(), A.delay_review_corr(m, fit_on="sample", k=50).first()
    assert everything.r == sample.r and everything.n == sample.n and everything.slope != sample.slope
    line = A.delay_review_trendline(m, k=50).first()
    assert (line.slope, line.intercept) == (sample.slope, sample.intercept)
    with pytest.raises(ValueError):
        A.delay_review_corr(m, fit_on="some")


def test_tier_labels_are_a_parameter(spark):
    m = registry.queries()["master"](spark, SF_SMALL)
    names = ("gold", "silver", "tin")
    got = A.seller_tiers(m, cuts=(70, 40), labels=names).collect()
    assert [r.tier for r in got] == [n for n in names if n in {r.tier for r in got}] and sum(r.sellers for r in got) > 0
    with pytest.raises(ValueError):
        A.seller_health(m, labels=names)
