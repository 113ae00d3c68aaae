"""Exact top-k inner products with a KD-tree per shard.

Rows are dealt to shards of ``SHARD`` rows on average by a hash; each shard becomes one row
that holds its KD-tree: median splits along the widest side down to leaves of ``LEAF`` rows,
and a tight bounding box per node.  The highest inner product that a box can hold bounds all
rows below it, so a query visits nodes best first and stops when the best bound left is
below the k-th score it already has (equal bounds are still visited: ties go to the smaller
id).  The k-th score travels: each block of queries first searches one shard, and its k-th
scores are the floor for all other shards, which return only rows that can still matter.

Queries meet shards in blocks of ``QUERIES``; neither side is ever whole in one place.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor does a query row whose id is null; vectors of another length than the query's are not its candidates;
empty vectors score 0 among each other; rows with equal ids are separate rows, and a query excludes candidates that
carry its own id; scores beyond 64 bits saturate; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, row_hash, stored

SHARD, LEAF, QUERIES = 20_000, 128, 1024
_EXACT = float(1 << 53)
OUT = "query_id bigint, vec_id bigint, score bigint"


def scaled(vec: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component, as doubles."""
    return F.transform(vec, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double"))


def usable(vec: Column) -> Column:
    return F.coalesce(vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def build_tree(points: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes as arrays: rows ``order[start:stop]`` below each, children or -1, box low and high."""
    order = np.arange(len(points))
    start, stop, left, right, low, high = [], [], [], [], [], []

    def add(a, b):
        rows = points[order[a:b]]
        start.append(a), stop.append(b), left.append(-1), right.append(-1)
        low.append(rows.min(axis=0)), high.append(rows.max(axis=0))
        return len(start) - 1

    todo = [add(0, len(points))]
    while todo:
        n = todo.pop()
        a, b = start[n], stop[n]
        wide = high[n] - low[n]
        if b - a <= leaf or not wide.size or wide.max() == 0:
            continue
        axis, mid = int(wide.argmax()), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(points[order[a:b], axis], mid)]
        left[n], right[n] = add(a, a + mid), add(a + mid, b)
        todo += [left[n], right[n]]
    return {"points": points[order], "order": order, "start": start, "stop": stop, "left": left, "right": right,
            "low": np.array(low), "high": np.array(high)}


def _products(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, saturated to 64 bits."""
    if not q.size:
        return np.zeros(len(points), np.int64)
    if np.abs(points).max(initial=0) * np.abs(q).max(initial=0) * q.size < _EXACT:
        return (points.astype(np.float64) @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(p, q)) for p in points]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], dtype=np.int64)


def search(tree: dict, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int):
    """Rows (query id, id, score) of the k best per query among rows that score >= its floor."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    high, low = tree["high"].astype(float), tree["low"].astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = up @ high.T + down @ low.T
    slack = 1e-9 * (up @ np.abs(high).T - down @ np.abs(low).T) + 0.5
    bounds = np.nan_to_num(bounds + slack, nan=np.inf)
    start, stop, left, right, points = tree["start"], tree["stop"], tree["left"], tree["right"], tree["points"]
    named = ids[tree["order"]]
    out = []
    for t, (q, own) in enumerate(zip(queries, query_ids)):
        bound, kth = bounds[t], floors[t]
        best = []  # heap of (score, -id), the worst first
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            n = heapq.heappop(heap)[1]
            if left[n] >= 0:
                for c in (left[n], right[n]):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            here = named[start[n]:stop[n]]
            score = _products(points[start[n]:stop[n]], q)
            pick = np.flatnonzero((score >= kth) & (here != own))
            if len(pick) > k:  # only the k best of the leaf can enter; ties by id
                pick = pick[np.lexsort((here[pick], -score[pick]))[:k]]
            for s, i in zip(score[pick].tolist(), here[pick].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                kth = max(kth, best[0][0])
        out += [(own, -i, s) for s, i in best]
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vec_col)).alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col(vec_col)))
    base = stored(base.withColumn("dim", F.size("v")).where("id IS NOT NULL"))
    n, m = base.agg(F.count(F.lit(1)), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    # rows with equal ids and vectors differ by nothing, so the hash takes in a row's place too
    place = base.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        if np.abs(points).max(initial=0) < 1 << 24:  # whole numbers that fit four bytes
            points = points.astype(np.float32)
        held = pickle.dumps((build_tree(points), pdf["id"].to_numpy()), protocol=5)
        return pd.DataFrame({"dim": [pdf["dim"].iat[0]], "shard": [pdf["shard"].iat[0]], "tree": [held]})

    trees = stored(place.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pickle.dumps((np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()), protocol=5)
        return pd.DataFrame({"dim": [pdf["dim"].iat[0]], "block": [pdf["block"].iat[0]], "queries": [held]})

    asked = base.where("q").dropDuplicates(["id", "v"]) \
                .withColumn("block", F.pmod(row_hash(F.col("id")), F.lit(blocks)).cast("int"))
    asked = stored(asked.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, queries binary"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]  # a group is one block of queries and one shard
        tree, ids = pickle.loads(r["tree"])
        queries, query_ids = pickle.loads(r["queries"])
        known = {f["query_id"]: f["floor"] for f in r["floors"]} if r["floors"] is not None else {}
        floors = np.array([known.get(i, -np.inf) for i in query_ids.tolist()], dtype=float)
        found = search(tree, ids, queries, query_ids, floors, k)
        out = pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        return out.assign(dim=r["dim"], block=r["block"])[["dim", "block", "query_id", "vec_id", "score"]]

    def searched(pairs: DataFrame) -> DataFrame:
        return pairs.join(trees, ["dim", "shard"]).select("dim", "block", "shard", "tree", "queries", "floors") \
                    .groupBy("dim", "shard", "block").applyInPandas(look, f"dim int, block int, {OUT}")

    none = F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>")
    # the block's first shard: the one at its number among the shards that its length has
    spots = trees.select("dim", "shard")
    first = spots.groupBy("dim").agg(F.sort_array(F.collect_list("shard")).alias("all"))
    home = asked.join(first, "dim").select("dim", "block", F.element_at(
        "all", (F.col("block") % F.size("all") + 1).cast("int")).alias("shard"))
    one = stored(searched(home.join(asked, ["dim", "block"]).withColumn("floors", none)))
    kth = one.groupBy("dim", "block", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floors = kth.where(F.col("n") >= k).groupBy("dim", "block") \
                .agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # at most a block's queries
    # (block, shard) numbers alone are paired; queries and trees then join by their own keys
    pairs = home.withColumnRenamed("shard", "done").join(spots, "dim").where("shard <> done").drop("done")
    rest = searched(pairs.join(asked, ["dim", "block"]).join(floors, ["dim", "block"], "left"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
              .select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
