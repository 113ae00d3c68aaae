"""The counting select equals a sort, whatever the keys, ties, nulls and directions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from om_paths import SF_SMALL
from ordermill.operators import selection
from ordermill.operators.ranking import exact_quantiles, global_ntile, ntiles, quantile_double
from ordermill.plans import registry


def ordered(rows, columns, order):
    """Rows by an order, nulls first when ascending and last when descending."""
    out = list(rows)
    for name, ascending in reversed(order):
        k = columns.index(name)
        out.sort(key=lambda r: (r[k] is not None, r[k] if r[k] is not None else 0), reverse=False)
        if not ascending:
            some, none = [r for r in out if r[k] is not None], [r for r in out if r[k] is None]
            some.sort(key=lambda r: r[k], reverse=True)
            out = some + none
    return out


COLUMNS = ["i", "m", "s", "d", "t", "w"]


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(11)
    texts = ["", "a", "a\0", "ab", "zebra", "Ärger", "\U0001f600", "x" * 40, "x" * 39 + "y", "same-prefix-1", "same-prefix-2"]
    rows = []
    for k in range(4000):
        hot = k % 3 == 0
        rows.append((
            None if k % 50 == 1 else rnd.choice([-2**62, 2**62, 0, 7]) if k % 97 == 0 else 5 if hot else rnd.randint(-10**9, 10**9),
            None if k % 41 == 1 else Decimal(rnd.randint(-10**6, 10**6)).scaleb(-2),
            None if k % 61 == 1 else rnd.choice(texts) if hot else f"id-{rnd.randrange(3000):06d}",
            dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randrange(4000)),
            dt.datetime(1960, 1, 1) + dt.timedelta(microseconds=rnd.randrange(10**16)),
            Decimal(rnd.choice([1, -1]) * rnd.randrange(10**22)).scaleb(-2)))
    schema = "i long, m decimal(12,2), s string, d date, t timestamp_ntz, w decimal(24,2)"
    return rows, spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.mark.parametrize("order", [
    [("i", True)], [("i", False)], [("m", True), ("i", False)], [("s", True)], [("s", False), ("i", True)], [("d", False), ("s", True)],
    [("t", True)], [("w", False)], [("w", True), ("s", False)]])
def test_places_equal_a_sort(mixed, order):
    rows, df = mixed
    places = [0, 1, 39, 1300, 1333, 2000, 2666, 3998, 3999]
    ((n, got),) = selection.select_ranks(df, [order], [lambda n: places])[()]
    want = ordered(rows, COLUMNS, order)
    cols = [COLUMNS.index(c) for c, _ in order]
    assert n == len(rows) and got == [tuple(want[p][c] for c in cols) for p in places]


def test_few_rows_are_read_and_many_are_counted(mixed, monkeypatch):
    rows, df = mixed
    order = [("s", False), ("i", True)]
    want = selection.select_ranks(df, [order], [lambda n: range(0, n, 500)])
    monkeypatch.setattr(selection, "FETCH", 0)   # down to the last key by counting
    monkeypatch.setattr(selection, "BUCKETS", 5)
    assert selection.select_ranks(df, [order], [lambda n: range(0, n, 500)]) == want


@pytest.mark.parametrize("ascending", [True, False])
def test_known_rows_only(mixed, ascending):
    rows, df = mixed
    ((n, got),) = selection.select_ranks(df, [[("i", ascending)]], [lambda n: [0, n // 2, n - 1]], known=True)[()]
    known = sorted((r[0] for r in rows if r[0] is not None), reverse=not ascending)
    assert n == len(known) and [g[0] for g in got] == [known[0], known[n // 2], known[-1]]


def test_groups_and_weights(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None]), rnd.randint(0, 30), rnd.randint(1, 5)) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v long, c long")
    got = selection.select_ranks(df, [[("v", True)]], [lambda n: [0, n // 3, n - 1]], by=["g"], weight="c")
    for g in ("a", "b", None):
        flat = sorted(v for x, v, c in data if x == g for _ in range(c))
        ((n, places),) = got[(g,)]
        assert n == len(flat) and [p[0] for p in places] == [flat[0], flat[n // 3], flat[-1]]


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 9])
def test_ntile_of_few_rows(spark, rows):
    df = spark.createDataFrame([(k % 2, f"c{k}") for k in range(rows)], "v long, id string")
    order = [("v", False), ("id", True)]
    assert global_ntile(df, 4, order, "t").exceptAll(global_ntile(df, 4, order, "t", method="window")).count() == 0


def test_ntile_with_nulls_and_text_ids(mixed):
    _, df = mixed
    keyed = df.withColumn("key", F.concat_ws("/", "s", "t", "w"))
    order = [("i", False), ("key", True)]
    a, b = (global_ntile(keyed, 7, order, "t7", method=m) for m in ("select", "window"))
    assert a.select("key", "t7").exceptAll(b.select("key", "t7")).count() == 0


def test_several_ntiles_at_once(mixed):
    _, df = mixed
    orders = {"a": [("i", True), ("t", True)], "b": [("w", False), ("t", True)], "c": [("s", True), ("t", False)]}
    got = ntiles(df, 4, orders)
    want = df
    for name, order in orders.items():
        want = global_ntile(want, 4, order, name, method="window")
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_both_methods(spark, by):
    rnd = random.Random(9)
    data = [(rnd.choice("ab") if k % 9 else None, Decimal(rnd.randint(-500, 90000)).scaleb(-2) if k % 7 else None) for k in range(900)]
    df = spark.createDataFrame(data, "g string, v decimal(12,2)")
    probs = [0.0, 0.01, 0.5, 0.333, 0.99, 1.0]
    a, b = (exact_quantiles(df, "v", probs, by=by, method=m) for m in ("count", "range"))
    assert a.schema.simpleString() == b.schema.simpleString()
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    none = exact_quantiles(df.where("v IS NULL"), "v", [0.5], method="count").first()
    assert none.n is None and none.q0.lo is None and none.q0.den == 2


def test_doubles_take_the_range_method(spark):
    df = spark.createDataFrame([(x / 7,) for x in range(40)], "v double")
    got = exact_quantiles(df, "v", [0.5]).select(quantile_double(F.col("q0"))).first()[0]
    assert got == pytest.approx(19.5 / 7)
    with pytest.raises(TypeError):
        selection.select_ranks(df, [[("v", True)]], [lambda n: [0]])


def test_every_pass_shuffles_counts_only(mixed):
    """No range partitioning and no sort: a pass is an aggregation over exploded marks."""
    _, df = mixed
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: (seen.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1]
        selection.select_ranks(df, [[("i", True), ("s", True)]], [lambda n: [n // 2]])
    finally:
        type(df).collect = collect
    assert seen and not any("rangepartitioning" in p or "Sort [" in p for p in seen)


@pytest.mark.parametrize("name", ["clean_items", "price_bounds", "rfm_segments", "sql_rfm_scores"])
def test_queries_neither_rank_nor_write_twice(spark, name, monkeypatch):
    """Every job of these queries runs without the ranking (its range shuffle and checkpoint), and
    each frame is written once: the items, the master's parts, the customers."""
    import ordermill.session as session
    from ordermill.operators import clean, ranking
    from ordermill.plans import analyses, sql_suite
    registry.clear_products()
    monkeypatch.setattr(ranking, "ranked", None)  # any use would fail
    written = []

    def noted(df, columnar=False, bucket_by=()):
        written.append(tuple(df.columns))
        return session.materialize(df, columnar=columnar, bucket_by=bucket_by)
    for module in (clean, analyses, sql_suite, registry):
        monkeypatch.setattr(module, "materialize", noted)
    df = registry.queries()[name](spark, SF_SMALL)
    assert df.count() and len(written) == len(set(written))
    customers = [w for w in written if "frequency" in w]
    assert len(customers) == {"rfm_segments": 2, "sql_rfm_scores": 1}.get(name, 0)  # rfm_segments: and its result
    assert [w for w in written if "price" in w] == ([] if name == "sql_rfm_scores" else [tuple(registry.tables_for(spark, SF_SMALL).items.columns)])
    registry.clear_products()
