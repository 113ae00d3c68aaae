import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermill.llm import common, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors, components):
    """Covariance of the distinct integer vectors by exact products, then eigh."""
    ints = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, ints)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[Fraction(n * x[i] - sums[i], n) for i in range(d)] for x in fit]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    return ints, n, sums, v, values[::-1][:components], axes[:, ::-1][:, :components]


def test_query_on_the_table(spark):
    table = common.read_table(spark, SF, "embeddings")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    got = whitening.op13_whitening(spark, SF).collect()
    x = {k: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for k, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(np.float64), bias=True)
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * len(vectors)
    for r in got:
        e, v = values[-r.component], axes[:, -r.component]
        v = v if v[np.abs(v).argmax()] > 0 else -v
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum())
        assert r.whitened == pytest.approx(((x[r.vec_id] - sums / n) @ v) / np.sqrt(e), abs=1e-8)
        assert r.explained == pytest.approx(e / np.trace(cov), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_polarisation_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=5) * 10.0 ** rng.integers(-3, 4) + 1000).tolist()) for k in range(60)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits, errors = whitening.fit(common.stored(whitening.integer_vectors(df)))
    _, n, sums, v, values, _ = plain([r[1] for r in rows], 4)
    assert fits[5].n == n and fits[5].sums == sums and (fits[5].covariance == v).all() and errors[5] < 1e-9
    assert np.allclose(fits[5].values, values)


def test_huge_entries_stay_exact(spark):
    rows = [(1, [2.0 ** 60, 1.0]), (2, [-2.0 ** 61, 3.0]), (3, [2.0 ** 45, 2.0]), (4, [2.0 ** 53 + 2, -1.0]), (5, [1e100, 0.0]), (6, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part in (rows[:4], rows[:5]):
        fits, _ = whitening.fit(common.stored(whitening.integer_vectors(df.where(F.col("vec_id") <= len(part)))))
        _, n, sums, v, _, _ = plain([r[1] for r in part], 2)
        assert fits[2].n == n and fits[2].sums == sums
        assert (fits[2].covariance == v).all()
    assert whitening.integer_vectors(df).count() == 5


def test_deviation_beyond_64_bits(spark):
    rows = [(1, [2.0 ** 40, 1.0]), (2, [-2.0 ** 40, 3.0]), (3, [5.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    ints, n, sums, *_ = plain([r[1] for r in rows], 2)
    assert got == {k + 1: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for k, x in enumerate(ints)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [0.5, -0.0]),
            (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") \
              .withColumn("x", F.lit(1)).withColumn("n", F.lit("n")).withColumn("whitened", F.lit(0))
    out = sorted(((r.vec_id or 0, r.dimension, r.n, len(r.whitened)) for r in whitening.whiten(df).collect()))
    assert out == [(0, 2, 3, 2), (6, 2, 3, 2), (6, 2, 3, 2), (7, 2, 3, 2), (8, 3, 2, 1), (9, 3, 2, 1)]
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.where("vec_id = 6")).collect()
    assert len(one) == 2 and all(list(r.whitened) == [] for r in one)


def test_copies_do_not_move_the_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(50)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    many = spark.createDataFrame(rows + [rows[0]] * 500, "vec_id long, embedding array<double>").repartition(13)
    a, b = ({r.vec_id: tuple(r.whitened) for r in whitening.whiten(d).collect()} for d in (once, many))
    assert a == b
