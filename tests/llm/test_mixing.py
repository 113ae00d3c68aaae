import pytest
from pyspark.sql import functions as F

from ordermill.llm import mixing


def filled(sizes, weights, cap=3):
    """Targets by the stated rounds of sharing out."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        out = [cap * s if i in full else w * rest / share for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i in range(len(sizes)) if i not in full and out[i] >= cap * sizes[i]}
        if not over:
            return out
        full |= over
        if len(full) == len(sizes):
            return [float(cap * s) for s in sizes]


@pytest.mark.parametrize("sizes", [[10, 1000, 5], [1, 1, 1, 1, 500], [100, 100, 100], [7], [0, 50, 3]])
def test_targets_by_rounds(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    for name, want in zip(names, filled(sizes, weights)):
        assert got[name] == pytest.approx(want, abs=1e-6)


def test_cut_is_the_nearest_one(spark):
    rows = [("a", h * 7919 % (1 << 60), 1 + h % 13) for h in range(500)] + [(None, 5, 10), (None, 5, 10)]
    df = spark.createDataFrame(rows, "source string, h long, size long")
    budget = spark.createDataFrame([("a", 1000), (None, 3)], "source string, budget long")
    cut = {r.source: r.threshold for r in mixing.thresholds(df, budget, level_bits=3).collect()}
    taken = sum(s for src, h, s in rows if src == "a" and h < cut["a"])
    assert abs(taken - 1000) <= 13 / 2 + 1
    assert cut[None] <= 5  # both rows of one hash are 20 words, nothing is nearer to 3


def test_mix_of_odd_rows(odd_docs):
    plan, _ = mixing.mix(odd_docs.withColumn("copies", F.lit("x")))
    rows = plan.collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.copies <= 3 for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    clash = odd_docs.withColumn("_mix", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("threshold", F.lit(3))
    out = mixing.mix_documents(clash)
    assert out.columns == clash.columns
    assert out.count() == sum(r.copies for r in rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_documents(clash).collect()))


def test_mix_of_nothing(odd_docs):
    assert mixing.mix_documents(odd_docs.limit(0)).count() == 0
