"""The distributed ranking equals Spark's single-task window on tied data."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.operators.ranking import exact_quantiles, global_ntile, global_row_number, quantile_double, ranked


@pytest.fixture(scope="module")
def tied(spark):
    rnd = random.Random(7)
    # a third of the rows share one value: the hot-key case
    data = [(i, 1 if i % 3 == 0 else rnd.randint(0, 40), rnd.choice("abc")) for i in range(3000)]
    return spark.createDataFrame(data, "id long, v long, g string")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_number_matches_window(tied, parts):
    order = [("v", False), ("id", True)]
    a = global_row_number(tied, order, "rn", partitions=parts)
    b = global_row_number(tied, order, "rn", method="window")
    assert a.exceptAll(b).count() == 0 and a.count() == 3000


@pytest.mark.parametrize("k", [1, 4, 7, 5000])
def test_ntile_matches_window(tied, k):
    order = [("v", True), ("id", True)]
    a = global_ntile(tied, k, order, "t", partitions=5)
    b = global_ntile(tied, k, order, "t", method="window")
    assert a.exceptAll(b).count() == 0


def test_ntile_sizes_differ_by_at_most_one(tied):
    t = global_ntile(tied, 7, [("v", True), ("id", True)], "t")
    sizes = [r["count"] for r in t.groupBy("t").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 3000


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)], "id long, x long")
    r = ranked(df, [("id", True)], rank_col="rk", total_col="n", sum_cols=["x"], partitions=4)
    got = {row.id: (row.rk, row.cum_x, row.n) for row in r.collect()}
    run = 0
    for i in range(200):
        run += i % 5
        assert got[i] == (i + 1, run, 200)


def test_exact_quantiles_match_percentile(tied):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = exact_quantiles(tied, "v", probs, by=["g"])
    mine = {r.g: [r[f"v{i}"] for i in range(len(probs))] for r in
            q.select("g", *[quantile_double(F.col(f"q{i}")).alias(f"v{i}") for i in range(len(probs))]).collect()}
    ref = {r.g: r.p for r in tied.groupBy("g").agg(F.percentile("v", probs).alias("p")).collect()}
    assert mine.keys() == ref.keys()
    for g in ref:
        assert mine[g] == pytest.approx(ref[g])


def test_exact_quantiles_decimal_exact(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ["1.00", "2.00", "3.00", "10.00"]], "p decimal(12,2)")
    q = exact_quantiles(df, "p", [0.99]).first().q0
    # position (4 - 1) * 0.99 = 2.97 -> between 3.00 and 10.00, remainder 97/100
    assert (q.lo, q.hi, q.rem, q.den) == (Decimal("3.00"), Decimal("10.00"), 97, 100)
