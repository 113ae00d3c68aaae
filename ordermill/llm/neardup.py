"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c are at squared distance <= 2 - 2c.  After a fixed random
rotation the coordinates are split into blocks of ``BLOCK`` dimensions, each with a share of
the squared distance in proportion to its dimensions: two vectors that are near stay within
the share in at least one block.  Each block is range-joined on a grid over its first
coordinates, with cells ``WIDE`` times the block's radius; a vector is at home in one cell
and a guest in those that its radius reaches.  Candidates are verified exactly in double
precision on the original vectors, and a pair is counted in its first near block only, in
the home cell of its smaller member, so every pair is found once and none twice.

How many coordinates are gridded follows from a sample of the largest label, and changes no
result: where cells leave so many pairs and guests that the blocks together would take longer
than all pairs of the label, as with vectors that point everywhere, the whole vector is the
only block and the label its only cell.  A crowded cell is dealt to pairs of chunks of at most ``CHUNK``
rows on average, so no task holds a whole cell; rows get their vector after they are dealt.
Equal vectors are joined once, by a weight; the pairs of a group are never listed: tasks
return link counts per vector and a spanning forest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors with a null label, link with nothing and form a component of their own; vectors of different lengths
don't link; rows with equal vec_id are separate rows; a null vec_id takes part, and
``component_id`` is the smallest known vec_id of the component; an empty table gives no
rows; extra columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read_table, row_hash, short_shuffles, small_batches, stored

BLOCK, WIDE, CHUNK, SEED = 8, 4.0, 8000, 20250
SAMPLE, ROW = 1000, 1000  # vectors that the grid is chosen by; compared pairs that take as long as a row sent
SPOTS = 1 << 14           # cells of vectors that Python makes at once, about


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)  # first, so that no square overflows
    v = vectors / big
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn


@short_shuffles
@small_batches
def link_vectors(rows: DataFrame, threshold: float = 0.98, *, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows``."""
    spark = rows.sparkSession
    v = F.col("v")
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
                        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    base = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v")).withColumn("ok", usable)
    # equal vectors are one node; its key is a 128-bit digest of label and vector
    digest = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform(
        v, lambda x: F.when(x == 0, 0.0).otherwise(x).cast("string")), ",")))
    keyed = stored(base.withColumn("key", F.when(F.col("ok"), digest)))
    given = rows.schema[vec_col].dataType  # floats are stored as floats: they are doubles without loss
    nodes = stored(keyed.where("ok").groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"),
                                                        F.first("label").alias("label"), F.first("v").cast(given).alias("v"))
                   .withColumn("num", F.monotonically_increasing_id()))
    top = nodes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")) \
               .orderBy(F.desc("n"), "dim", "label").first()
    if top is None:
        links = edges = None
    else:
        found = stored(_block_join(nodes, threshold, _grid(nodes, threshold, top)))
        links = found.where("b IS NULL").groupBy(F.col("a").alias("num")).agg(F.sum("n").alias("far"))
        edges = components(found.where("b IS NOT NULL").select("a", "b"))
    out = keyed.select("vec_id", "key")
    if links is None:
        return out.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    lows = nodes.join(edges.withColumnRenamed("node", "num"), "num", "left") \
                .withColumn("root", F.coalesce("root", "num"))
    comp = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = lows.join(comp, "root").join(links, "num", "left") \
                .select("key", "component_id", (F.col("w") - 1 + F.coalesce("far", F.lit(0))).cast("bigint").alias("n_links"))
    joined = out.join(facts, "key", "left")
    label = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         label.alias("component_id"), F.coalesce(F.col("vec_id") == label, F.lit(False)).alias("kept"))


def _reach(y: np.ndarray, lo: int, hi: int, share: float) -> tuple[np.ndarray, ...]:
    """Of a block's coordinates: the home cell, the least and the greatest cell that the radius reaches."""
    radius = math.sqrt(share * (hi - lo) / y.shape[1]) + 1e-9
    z, side = y[:, lo:hi], WIDE * radius
    return tuple(np.floor((z + move) / side).astype(np.int64) for move in (0.0, -radius, radius))


def _share(threshold: float) -> float:
    """Squared distance of two near unit vectors, at most."""
    return 2 - 2 * threshold + 1e-9


def _grid(nodes: DataFrame, threshold: float, top) -> int:
    """How many coordinates of each block are gridded; 0: the whole vector is one block, without a grid."""
    if top["n"] <= CHUNK:
        return 0
    some = nodes.where((F.col("label") == F.lit(top["label"])) & (F.size("v") == top["dim"])).orderBy("key").limit(SAMPLE)
    y = _units(np.array([r[0] for r in some.select("v").collect()], np.float64), rotation(top["dim"]))
    # by gridded coordinates, over all blocks: share of pairs that meet in a cell, cells of a vector
    left, spots, blocks = np.zeros(BLOCK), np.zeros(BLOCK), math.ceil(top["dim"] / BLOCK)
    for lo in range(0, top["dim"], BLOCK):
        home, least, most = _reach(y, lo, min(lo + BLOCK, top["dim"]), _share(threshold))
        meet, reached = np.ones((len(y), len(y)), bool), np.ones(len(y))
        for c in range(BLOCK):
            if c < home.shape[1]:
                meet &= (home[:, None, c] >= least[None, :, c]) & (home[:, None, c] <= most[None, :, c])
                reached = reached * (most[:, c] - least[:, c] + 1)
            left[c] += meet.mean()
            spots[c] += reached.mean()
    # a vector's share of the work, in compared pairs
    chunks = lambda share: np.ceil(share * top["n"] / CHUNK)
    cost = left * top["n"] + ROW * (spots + blocks) * chunks(left / blocks)
    return 0 if cost.min() >= top["n"] / 2 + ROW * (chunks(1) + 1) else int(cost.argmin()) + 1


def _block_join(nodes: DataFrame, threshold: float, grid: int) -> DataFrame:
    """Rows (a, null, n): n linked rows of other nodes; rows (a, b, null): spanning links."""
    share = _share(threshold)

    def spots_of(y):
        """(row, cell, home) of every vector: one per block and cell."""
        out, dim = [], y.shape[1]
        for blk, lo in enumerate(range(0, dim, BLOCK)):
            home, least, most = _reach(y, lo, min(lo + BLOCK, dim), share)
            at, there = np.arange(len(y)), np.zeros((len(y), 0), np.int64)
            for c in range(min(grid, home.shape[1])):
                parts = [(k, home[at[k], c] + m) for m in (-1, 0, 1)
                         for k in [np.flatnonzero((home[at, c] + m >= least[at, c]) & (home[at, c] + m <= most[at, c]))]]
                pick = np.concatenate([k for k, _ in parts])
                there = np.column_stack([there[pick], np.concatenate([x for _, x in parts])])
                at = at[pick]
            names = [f"{dim}:{blk}:" + ",".join(map(str, c)) for c in there.tolist()]
            out.append(pd.DataFrame({"at": at, "cell": names, "home": (there == home[at, :there.shape[1]]).all(axis=1)}))
        return pd.concat(out)

    def cells(frames):
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                step = max(1, int(SPOTS / (math.ceil(dim / BLOCK) * 1.5 ** grid)))
                for s in range(0, len(part), step):
                    few = part.iloc[s:s + step]
                    spots = spots_of(_units(np.stack(few["v"].to_numpy()).astype(np.float64), rotation(dim)))
                    keep = few.iloc[spots["at"].to_numpy()]
                    yield pd.DataFrame({"label": keep["label"].to_numpy(), "cell": spots["cell"].to_numpy(),
                                        "home": spots["home"].to_numpy(), "num": keep["num"].to_numpy()})

    kind = nodes.schema["label"].dataType.simpleString()
    if grid:
        spots = stored(nodes.select("num", "label", "v").repartition("num")
                       .mapInPandas(cells, f"label {kind}, cell string, home boolean, num bigint"))
    else:
        spots = nodes.select("label", F.concat(F.size("v").cast("string"), F.lit(":whole")).alias("cell"),
                             F.lit(True).alias("home"), "num")
    sums = spots.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("crowd"), F.max("home").alias("lived"))
    busy = sums.where("lived AND crowd > 1").select("label", "cell", F.ceil(F.col("crowd") / CHUNK).cast("int").alias("parts"))
    dealt = spots.join(busy, ["label", "cell"]).withColumn("mine", F.pmod(row_hash(F.col("num")), F.col("parts")).cast("int"))
    # home rows stand in row i of the chunk grid, all rows in column j; without guests half of the grid is enough
    last = F.col("parts") - 1
    over, under = (F.sequence(F.lit(0), last),) * 2 if grid else (F.sequence("mine", last), F.sequence(F.lit(0), F.col("mine")))
    sides = F.concat(
        F.when(F.col("home"), F.transform(over, lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(True).alias("query"))))
         .otherwise(F.array().cast("array<struct<i:int,j:int,query:boolean>>")),
        F.transform(under, lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("query"))))
    dealt = dealt.withColumn("_s", F.explode(sides)).select("label", "cell", "_s.i", "_s.j", "_s.query", "num")
    dealt = dealt.join(nodes.select("num", "w", "v"), "num")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["query"]], pdf[~pdf["query"]]
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="Int64")})
        if left.empty or right.empty:
            return empty
        dim, name = pdf["cell"].iat[0].split(":")[:2]
        dim, whole = int(dim), name == "whole"
        blk = 0 if whole else int(name)
        cut = [(0, dim)] if whole else [(lo, min(lo + BLOCK, dim)) for lo in range(0, dim, BLOCK)]
        budget = np.array([share * (b - a) / dim for a, b in cut])
        ordered = not whole or pdf["i"].iat[0] == pdf["j"].iat[0]  # else the chunks are different rows
        turn = rotation(dim)
        ka, kb = left["num"].to_numpy(), right["num"].to_numpy()
        xa, xb = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float)
        wa, wb = left["w"].to_numpy(), right["w"].to_numpy()
        ya, yb = _units(xa, turn), _units(xb, turn)
        # norms of scaled vectors: no component's square overflows or vanishes
        sa, sb = np.abs(xa).max(axis=1, keepdims=True), np.abs(xb).max(axis=1, keepdims=True)
        xa, xb = xa / sa, xb / sb
        na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
        lo, hi = cut[blk]
        pa_, pb_ = ya[:, lo:hi], yb[:, lo:hi]
        qa, qb = (pa_ ** 2).sum(axis=1), (pb_ ** 2).sum(axis=1)
        far_a, far_b, tree = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64), np.arange(len(left) + len(right))
        edges = []
        step = max(1, (1 << 20) // len(right))
        for s in range(0, len(left), step):
            e = s + step
            d = pa_[s:e] @ pb_.T
            d *= -2
            d += qa[s:e, None]
            d += qb[None, :]
            i, j = np.nonzero(d <= budget[blk] + 1e-12)
            i = i + s
            if ordered:
                ok = ka[i] < kb[j]
                i, j = i[ok], j[ok]
            for t in range(0, len(i), 8192):
                p, q = i[t:t + 8192], j[t:t + 8192]
                cos = (xa[p] * xb[q]).sum(axis=1) / (na[p] * nb[q])
                near = cos >= threshold
                p, q = p[near], q[near]
                if not len(p):
                    continue
                gaps = np.add.reduceat((ya[p] - yb[q]) ** 2, [a for a, _ in cut], axis=1)
                first = (gaps <= budget + 1e-12).argmax(axis=1) == blk
                p, q = p[first], q[first]
                np.add.at(far_a, p, wb[q])
                np.add.at(far_b, q, wa[p])
                apart = np.flatnonzero(tree[p] != tree[q + len(left)])
                for a, b in zip(p[apart].tolist(), q[apart].tolist()):
                    ra, rb = tree[a], tree[len(left) + b]
                    if ra != rb:
                        tree[tree == ra] = rb
                        edges.append((ka[a], kb[b]))
        if not edges:
            return empty
        fa, fb = far_a > 0, far_b > 0
        nodes_ = [*ka[fa], *kb[fb]]
        return pd.DataFrame({"a": [*nodes_, *(a for a, _ in edges)], "b": pd.array([*[None] * len(nodes_), *(b for _, b in edges)], dtype="Int64"),
                             "n": pd.array([*far_a[fa], *far_b[fb], *([None] * len(edges))], dtype="Int64")})

    return dealt.groupBy("label", "cell", "i", "j").applyInPandas(join, "a bigint, b bigint, n bigint")


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
good AS (
  SELECT vec_id, label, v FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN comp ON comp.x = vec_id
"""
