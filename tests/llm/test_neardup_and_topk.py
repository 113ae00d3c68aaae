import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermill.llm import neardup, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=5, n=260, dim=20):
    rng = np.random.default_rng(seed)
    out = [(i, rng.standard_normal(dim).tolist(), int(i % 2)) for i in range(n)]
    for k in range(12):  # clusters of near and equal vectors, and chains
        v = np.array(out[k][1])
        for j in range(9):
            w = v + rng.standard_normal(dim) * 0.03 * j
            out.append((len(out), (w * (1 + j)).tolist(), out[k][2]))
        out.append((len(out), v.tolist(), out[k][2]))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] + [0.0] * (dim - 1), [1.0, None] * (dim // 2), [1.0] * 3, [2.0] * 3]
    out += [(len(out) + i, v, 0) for i, v in enumerate(odd)]
    out += [(9000, out[0][1], None), (None, out[0][1], 0), (9001, out[0][1], 0), (9001, out[0][1], 0)]
    return out


def brute(rows, threshold):
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    at = [k for k, (_, v, label) in enumerate(rows) if good(v, label)]
    links, parent = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in at:
        for j in at:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            low[root(k)] = min(rows[k][0], low.get(root(k), 1 << 60))
    return sorted((str(r[0]), links[k], str(low.get(root(k)))) for k, r in enumerate(rows))


@pytest.mark.parametrize("chunk", [4, 2000])
def test_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("w", F.lit(1))
    got = neardup.link_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("chunk,grid", [(4, 0), (25, 0), (25, 1), (4, 3)])
def test_any_grid_gives_the_same_links(spark, monkeypatch, chunk, grid):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "_grid", lambda *_: grid)
    rows = vectors(n=90)
    got = neardup.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows, 0.98)


@pytest.mark.parametrize("grid", [0, 2])
def test_cells_are_kept_without_vectors(spark, monkeypatch, grid):
    """A vector has many cells: it is looked up once they are dealt, not written with each."""
    seen, stored = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df: (seen.append(set(df.columns)), stored(df))[1])
    monkeypatch.setattr(neardup, "_grid", lambda *_: grid, raising=False)
    assert neardup.link_vectors(spark.createDataFrame(vectors(n=40), SCHEMA)).count() > 0
    assert not any({"cell", "v"} <= c for c in seen) and any("cell" in c for c in seen) == (grid > 0)


def test_clusters_are_gridded(spark):
    """Tight clusters lie in cells of their own, so that few pairs are compared."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((300, 64))
    rows = [(f"{i:05d}", (centres[i % 300] + 0.01 * rng.standard_normal(64)).tolist(), 0) for i in range(1500)]
    nodes = spark.createDataFrame(rows, "key string, v array<float>, label int")
    top = {"n": 10 ** 6, "dim": 64, "label": 0}
    assert neardup._grid(nodes, 0.9999, top) > 0
    assert neardup._grid(nodes, 0.9999, top | {"n": neardup.CHUNK}) == 0


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.link_vectors(df).count() == 0
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    only = spark.createDataFrame([(3, None, 1), (None, [0.0], 1)], SCHEMA)
    assert sorted(map(str, neardup.link_vectors(only).select("vec_id", "n_links", "kept").collect())) == [
        "Row(vec_id=3, n_links=0, kept=True)", "Row(vec_id=None, n_links=0, kept=False)"]


@pytest.mark.parametrize("shard_rows,query_rows", [(30, 3), (100_000, 1000)])
def test_top_k_equals_brute_force(spark, shard_rows, query_rows):
    rows = vectors(n=300)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, query_rows=query_rows)
    out = {}
    for r in got.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    pts = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, q in pts:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in pts if j != i and len(v) == len(q))[:5]
            if best:
                want[i] = {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
    assert out == want


def test_huge_components_saturate(spark):
    df = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1), (2, [-1e30], 1)], SCHEMA)
    rows = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 2 ** 63 - 1), (2, -2 ** 63)]
