"""N-gram Jaccard join by grouped prefixes.

A text's set is its distinct word n-grams (all its words as one if it has fewer than n);
two texts link when 100 * |A & B| >= percent * |A | B|.

1. Every text becomes its size, a 128-bit key of its set, and its *prefix*: the first
   size - ceil(percent * size / 100) + 1 elements in a global order.  Linked sets share an
   element of both prefixes.  Any order is right; the one used puts frequent elements last,
   so common lines and passages stay out of prefixes.  Frequencies are counted over all
   texts (an element is missed only where it is rare within every run of texts), and the
   ``FREQUENT`` most frequent elements are kept; the rest are ordered by hash.
2. Texts with equal sets are one member; members with equal prefix and size are one *group*.
   Groups meet where they share a prefix element.  A pair of groups is dropped if sizes, or
   the elements that either shares with nobody, rule the threshold out.
3. Remaining pairs are expanded to members.  A mark of a set, the parities of its elements' counts by place in a
   bitmap, bounds from below in how many elements two sets differ: it rules most far pairs out before their texts
   are fetched, the others are verified exactly on their sets.

Nothing pairs up a crowd: in each round every member is verified against one pivot among
those it shares an element with, links are contracted into components, and only pairs of
members in different components are looked at again.  When few such pairs are left, or a
round settles few members, the pairs left are met in the block of the first element that they
share: all before it in either prefix is not shared, which rules out all but near pairs in the
blocks of frequent elements.  Those are verified, so no link between components is missed.

Defined results: null, empty and blank texts have an empty set, link with nothing and are
their own component; a null id takes part, and ``component_id`` is the smallest known id
of the component; repeated rows link as equal sets; an empty table gives no rows; extra
columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, free_name, read_table, row_hash, short_shuffles, slices, small_batches, stored
from .words import combined, starts_of, word_hashes

FREQUENT = 1 << 18   # elements that are ordered by frequency
SLICE = 1 << 20      # bytes of text handled at once, unless one text is longer
RUN_ELEMENTS, RUN_LEAST = 2_000_000, 4  # an element counts once it comes so often among so many
SMALL, BROADCAST_ROWS = 64, 200_000  # groups that may share an element and be paired; rows sent to all tasks at most
MARK = 1024          # bits of a member's mark, a multiple of 128
REST_PAIRS, SETTLED = 4, 0.8         # pairs left per member, or share of members left, that end the pivot rounds


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted set of element hashes of every text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: only A-Z change
    h, start, _, _ = word_hashes(raw)
    bounds = np.append(np.searchsorted(start, starts_of(raw)), len(h))
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        size = hi - lo
        out.append(np.unique(combined(h[lo:hi], min(n, size))) if size else h[:0])
    return out


def needed(size, percent: int):
    """Least overlap that a set of this size needs with any linked set."""
    if isinstance(size, Column):
        return F.ceil(percent * size / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    return (percent * size + 99) // 100


def prefix_size(size: int, percent: int) -> int:
    return int(size - needed(size, percent) + 1)


def frequent_elements(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of the most frequent elements over all texts, the least frequent first."""
    def run(batches):
        held, count = [], 0
        for batch in batches:
            for lo, some in slices(batch.column(0), 256, SLICE):
                sets = shingle_sets(batch.slice(lo, some).column(0).to_pylist(), n)
                held += sets
                count += sum(map(len, sets))
                if count >= RUN_ELEMENTS:
                    yield counted(held)
                    held, count = [], 0
        if held:
            yield counted(held)

    def counted(sets):
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times >= RUN_LEAST
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(times[often])], ["e", "n"])

    seen = stored(texts.mapInArrow(run, "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n")))
    # frequencies in steps of a sixteenth of a power of two: a table of a few hundred rows
    # tells from which step on the elements fit
    step = F.floor(16 * F.log2(F.col("n"))).cast("int")
    steps = sorted(seen.groupBy(step.alias("s")).count().collect(), reverse=True)
    room, least = FREQUENT, None
    for s, many in steps:
        if many > room:
            break
        room, least = room - many, s
    if least is None:
        return np.zeros(0, np.uint64)
    top = seen.where(step >= least).toPandas().sort_values(["n", "e"])  # FREQUENT rows at most
    return top["e"].to_numpy(dtype=np.int64).view(np.uint64).copy()


class Order:
    """The global order: elements that are not frequent by hash, then the frequent ones."""

    def __init__(self, frequent: np.ndarray):
        self.by_hash = np.argsort(frequent)
        self.sorted = frequent[self.by_hash]

    def first(self, values: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` elements of a sorted set."""
        if not len(self.sorted):
            return values[:k]
        at = np.minimum(np.searchsorted(self.sorted, values), len(self.sorted) - 1)
        common = self.sorted[at] == values
        rare = values[~common]
        if len(rare) >= k:
            return rare[:k]
        some = values[common]
        rank = self.by_hash[at[common]]
        return np.concatenate([rare, some[np.argsort(rank)[:k - len(rare)]]])


def signatures(docs: DataFrame, n: int, percent: int, order: Order) -> DataFrame:
    """(id, text_hash, size, key, group, prefix) from (id, text, text_hash)."""
    def run(batches):
        for batch in batches:
            for lo, some in slices(batch.column(1), 128, SLICE):
                part = batch.slice(lo, some)
                sets = shingle_sets(part.column(1).to_pylist(), n)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                heads = [order.first(s, prefix_size(len(s), percent)).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                groups = [hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).hexdigest()
                          if len(s) else None for s, p in zip(sets, heads)]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in heads])])
                prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()),
                     pa.array(groups, pa.string()), prefix], ["id", "text_hash", "size", "key", "group", "prefix"])

    return docs.select("id", "text", "text_hash").mapInArrow(
        run, "id bigint, text_hash string, size bigint, key string, group string, prefix array<bigint>")


def _marked(texts: DataFrame, n: int) -> DataFrame:
    """(m, f0, f1, b0, b1, ...) from (m, text): bit i of the b tells whether an odd number of the set's elements is i
    modulo ``MARK``; f0 and f1 hold the same modulo 128.  Two sets differ in as many elements as marks in bits, at least."""
    words_ = MARK // 64
    names = ["m", "f0", "f1", *(f"b{k}" for k in range(words_))]

    def run(batches):
        for batch in batches:
            for lo, some in slices(batch.column(1), 256, SLICE):
                part = batch.slice(lo, some)
                sets = shingle_sets(part.column(1).to_pylist(), n)
                odd = np.stack([np.bincount((x % np.uint64(MARK)).astype(np.int64), minlength=MARK) & 1 for x in sets])
                bits = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
                folds = [np.bitwise_xor.reduce(bits[:, k::2], axis=1) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, folds), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], names)

    return texts.select("m", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _differ(names: list[str]) -> Column:
    """In how many bits marks 1 and 2 differ."""
    return reduce(add, [F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in names])


def _near(percent: int, names: list[str]) -> Column:
    """Whether sets of these sizes and marks can link."""
    return (100 + percent) * _differ(names) <= (100 - percent) * (F.col("size1") + F.col("size2"))


def _verified(pairs: DataFrame, live: DataFrame, texts: DataFrame, marks: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of members that link.  Marks rule most others out; the texts of the rest travel, as they are
    smaller than their sets."""
    def run(frames):
        for pdf in frames:
            keep = []
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                once = list(dict.fromkeys([*part["x"], *part["y"]]))
                sets = dict(zip(once, shingle_sets(once, n)))
                for x, y in zip(part["x"], part["y"]):
                    p, q = sorted((sets[x], sets[y]), key=len)
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int((q[at] == p).sum())
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pdf.loc[keep, ["a", "b"]]

    bits = [f"b{k}" for k in range(MARK // 64)]
    of = live.select("m", "size").join(marks.select("m", *bits), "m")
    left, right = (of.select(F.col("m").alias(side), *[F.col(c).alias(f"{c}{i}") for c in ("size", *bits)])
                   for i, side in ((1, "a"), (2, "b")))
    close = stored(pairs.select("a", "b").join(left, "a").join(right, "b").where(_near(percent, bits)).select("a", "b"))
    sent = _sent(close)
    x = texts.select(F.col("m").alias("a"), F.col("text").alias("x")).join(sent, "a")
    y = texts.select(F.col("m").alias("b"), F.col("text").alias("y")).join(sent, "b")
    out = stored(x.join(y, ["a", "b"]).select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint"))
    discard(close)
    return out


def _possible(percent: int, s1, o1, s2, o2) -> Column:
    """Whether sets of these sizes can link if what they share starts at these places."""
    small, large, overlap = F.least(s1, s2), F.greatest(s1, s2), F.least(s1 - o1, s2 - o2)
    return (100 * small >= percent * large) & ((100 + percent) * overlap >= percent * (s1 + s2))


@short_shuffles
@small_batches
def join_documents(docs: DataFrame, n: int = 4, percent: int = 85, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, text_hash, size, key, component, n_members): per row its set's size and key, the
    smallest key of its component, and how many different sets that holds."""
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                       F.md5(text_col).alias("text_hash"))
    order = Order(frequent_elements(base.select("text"), n))
    signed = stored(signatures(base, n, percent, order))
    # equal sets are one member; a crowd of them is pre-aggregated to a row
    members = stored(signed.where("key IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.min("group").alias("group")))
    many = members.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    heads = signed.where("key IS NOT NULL").groupBy("group").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    # groups get short numbers, which the many postings carry
    crowd = stored(heads.join(many, "group").withColumn("gid", F.monotonically_increasing_id()))
    # prefixes are the largest table: what is used later is kept without them
    rows = stored(signed.select("id", "text_hash", "size", "key"))
    discard(signed)
    posting = crowd.select("gid", "size", F.posexplode("prefix").alias("place", "e"))
    crowds = posting.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posting = stored(posting.join(crowds, "e"))
    groups = stored(crowd.select("gid", "group", "members"))
    discard(crowd)
    # groups that can have a partner: by the places of what a pair shares first, where few share
    # an element; all groups that share an element with many, or that have several members
    few = posting.where(F.col("n") <= SMALL)
    x = few.select("e", *[F.col(c).alias(f"{c}1") for c in ("gid", "size", "place")])
    y = few.select("e", *[F.col(c).alias(f"{c}2") for c in ("gid", "size", "place")])
    met = x.join(y, "e").where("gid1 < gid2").where(100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2"))
    met = met.groupBy("gid1", "gid2", "size1", "size2").agg(
        F.min("place1").alias("place1"), F.min("place2").alias("place2"), F.count(F.lit(1)).alias("common"))
    # beyond what their prefixes share, two sets share no more than the longer rest after a prefix
    rest = F.greatest(needed(F.col("size1"), percent), needed(F.col("size2"), percent)) - 1
    met = met.where((100 + percent) * (F.col("common") + rest) >= percent * (F.col("size1") + F.col("size2")))
    met = met.where(_possible(percent, F.col("size1"), F.col("place1"), F.col("size2"), F.col("place2")))
    hopeful = met.select(F.explode(F.array("gid1", "gid2")).alias("gid")) \
                 .union(posting.where(F.col("n") > SMALL).select("gid")).union(groups.where("members > 1").select("gid")).distinct()
    # what a group shares with others starts at its first shared place: everything before is its own
    reach = posting.groupBy("gid").agg(F.min("place").alias("own"))
    known = groups.join(hopeful, "gid").join(reach, "gid", "left")
    # members that are left get short numbers too
    live = stored(members.join(known, "group").select("key", "gid", "copies", "text_hash", "size", "members",
                                                      F.coalesce("own", F.lit(0)).alias("own"))
                  .withColumn("m", F.monotonically_increasing_id()))
    wanted = _sent(live.select("text_hash", "m"))
    texts = stored(base.select("text", "text_hash").join(wanted, "text_hash").groupBy("m").agg(F.first("text").alias("text")))
    marks = stored(_marked(texts, n))
    # a block is a shared element, or a group of several members, which share their whole prefix
    each = live.select("m", "gid", "copies", "size", "own", "members").join(marks.select("m", "f0", "f1"), "m")
    blocks = stored(posting.select("e", F.lit(False).alias("own_group"), "gid", "place").join(each.drop("members"), "gid").drop("gid")
                    .unionByName(each.where("members > 1").select(
                        F.col("gid").alias("e"), F.lit(True).alias("own_group"), "m", "copies", "size", "f0", "f1",
                        F.lit(0).alias("own"), F.lit(0).alias("place"))))
    discard(posting, groups)
    comp, tried, before = stored(live.select("m", F.col("m").alias("comp"))), None, None
    block, names = ["e", "own_group"], ("m", "size", "own", "place", "comp", "f0", "f1")
    while True:
        now = stored(blocks.join(comp, "m"))
        discard(blocks)
        mixed = now.groupBy(block).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(block)
        blocks = stored(now.join(mixed, block))
        discard(now)
        per = blocks.groupBy(*block, "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
        left = per.groupBy(block).agg(((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", 2))) / 2).alias("p")).agg(F.sum("p")).first()[0]
        if not left:
            break
        open_ = blocks.select("m").distinct().count()
        # the pairs left at last: when they are few, or pivots no longer settle many members
        rest = left <= REST_PAIRS * open_ or (before is not None and open_ > SETTLED * before)
        before = open_
        x = blocks.select(*block, *[F.col(c).alias(f"{c}1") for c in names])
        if rest:
            # the first element that a pair shares comes early in the smaller of its sets
            small = x.where((100 + percent) * (F.col("size1") - F.col("place1")) >= 2 * percent * F.col("size1"))
            y = blocks.select(*block, *[F.col(c).alias(f"{c}2") for c in names])
            met = small.join(y, block).where("(size1 < size2 OR size1 = size2 AND m1 < m2) AND comp1 <> comp2")
        else:
            # the pivot of a block: most copies, least of its own, then by number; every round another
            rank = F.struct((-F.col("copies")).alias("c"), (F.col("own") / F.col("size")).alias("o"), *names)
            fresh = blocks if tried is None else blocks.join(tried, [*block, "m"], "left_anti")
            pivot = stored(fresh.groupBy(block).agg(F.min(rank).alias("p")).select(*block, "p.*"))
            tried = pivot.select(*block, "m") if tried is None else stored(tried.union(pivot.select(*block, "m")))
            met = x.join(pivot.select(*block, "c", "o", *[F.col(c).alias(f"{c}2") for c in names]), block).where("comp1 <> comp2")
        met = met.where(_possible(percent, *[F.col(f"{c}{i}") for i in (1, 2) for c in ("size", "place" if rest else "own")]))
        met = met.where(_near(percent, ["f0", "f1"]))
        if not rest:  # a member meets the best of its blocks' pivots
            met = met.groupBy("m1").agg(F.min(F.struct("c", "o", "m2")).alias("p")).select("m1", F.col("p.m2").alias("m2"))
        pairs = met.select(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).distinct()
        links, was = _verified(pairs, live, texts, marks, n, percent), comp
        comp = _contracted(was, links)
        discard(was, links)
        if rest:
            break
        blocks, whole = stored(blocks.drop("comp")), blocks
        discard(whole)
    discard(blocks, texts, marks)
    # of a component the smallest key is its name
    named = live.select("m", "key").join(comp, "m")
    named = named.join(named.groupBy("comp").agg(F.min("key").alias("component")), "comp").select("key", "component")
    label = members.select("key").join(named, "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    label = stored(label.join(size, "component"))
    discard(members, live, comp)
    out = stored(rows.join(label, "key", "left").select("id", "text_hash", "size", "key", "component", "n_members"))
    discard(rows, label)
    return out


def _contracted(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (m, comp) after joining the components that ``links`` connect."""
    left = comp.select(F.col("m").alias("a"), F.col("comp").alias("ca"))
    right = comp.select(F.col("m").alias("b"), F.col("comp").alias("cb"))
    merged = components(links.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return stored(comp.join(merged.withColumnRenamed("node", "comp"), "comp", "left")
                  .select("m", F.coalesce("root", "comp").alias("comp")))


def _labelled(joined: DataFrame) -> DataFrame:
    """``joined`` with component_id: the smallest id of the component."""
    low = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    return joined.join(low, "component", "left").withColumn(
        "component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_documents(read_table(spark, sf_dir, "documents"))
    return _labelled(joined).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", "n_members")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest text hash.
    Rows with an empty set stay, one for each id and text."""
    rows = join_documents(docs, n, percent)
    key, value = free_name(docs, "_kept_id"), free_name(docs, "_kept_hash")
    one, mark = free_name(docs, "_one"), free_name(docs, "_hash_of_text")
    low = rows.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))).alias("k")) \
        .select(F.col("k.id").alias(key), F.col("k.text_hash").alias(value))
    members = rows.where("component IS NOT NULL").select(F.col("id").alias("i"), F.col("text_hash").alias("h")).distinct()
    gone = stored(members.join(low, F.col("i").eqNullSafe(F.col(key)) & (F.col("h") == F.col(value)), "left_anti")
                  .select(F.col("i").alias(key), F.col("h").alias(value)))
    match = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & F.col(mark).eqNullSafe(F.col(value))
    keyed = docs.withColumn(mark, F.md5("text"))
    left = keyed.join(_sent(gone), match, "left_anti")
    # rows that repeat an id and a text: one of them stays
    again = stored(rows.groupBy("id", "text_hash").count().where("count > 1")
                   .select(F.col("id").alias(key), F.col("text_hash").alias(value)))
    discard(rows)
    if again.isEmpty():
        return left.select(*docs.columns)
    w = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    first = left.join(_sent(again), match, "left_semi").withColumn(one, F.row_number().over(w)).where(F.col(one) == 1)
    return left.join(_sent(again), match, "left_anti").select(*docs.columns).union(first.select(*docs.columns))


def _sent(keys: DataFrame) -> DataFrame:
    """A table of keys, marked to be sent to all tasks if it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM t),
k AS (SELECT doc_id, len(s) AS n, s, md5(array_to_string(s, chr(10))) AS key FROM d),
m AS (SELECT key, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY key),
e AS (SELECT key, n, unnest(s) AS e FROM m),
links AS (
  SELECT a.key AS x, b.key AS y FROM e a JOIN e b ON a.e = b.e AND a.key < b.key
  GROUP BY a.key, b.key, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(key, other) AS (SELECT key, key FROM m UNION SELECT r.key, b.y FROM reach r JOIN two_way b ON b.x = r.other),
comp AS (SELECT key, min(other) AS c FROM reach GROUP BY key),
size AS (SELECT c, count(*) AS n_members FROM comp GROUP BY c),
low AS (SELECT c, min(doc_id) AS component_id FROM k JOIN comp USING (key) GROUP BY c)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(low.component_id, k.doc_id) AS component_id, size.n_members
FROM k LEFT JOIN comp ON comp.key = k.key AND k.n > 0 LEFT JOIN size USING (c) LEFT JOIN low USING (c)
"""
