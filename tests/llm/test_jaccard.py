import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordermill.llm import common, jaccard, words


def shingles(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(r[0], low.get(root(i), 1 << 60))
    return [(r[0], len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))]


def corpus(seed):
    """Groups of near copies at all distances, chains, a passage in many texts, short texts."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    for g in range(12):
        words = rng.choices(vocabulary, k=rng.randint(5, 90))
        for c in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if c % 3 == 0:
                words = copy  # a chain
            rows.append((len(rows), " ".join(copy), "en", "s"))
    for _ in range(15):
        rows.append((len(rows), " ".join([*passage, *rng.choices(vocabulary, k=rng.randint(1, 40))]), "en", "s"))
    for text in ("Alone", "alone", "two words", "TWO  words", "a b c d", "a b c", None, "", "É x y z", "é x y z"):
        rows.append((len(rows), text, "en", "s"))
    return rows


@pytest.mark.parametrize("seed,n,percent,rest", [(1, 4, 85, 4), (2, 5, 80, 0), (3, 4, 60, 0), (4, 2, 50, 0)])
def test_components_equal_brute_force(make_docs, monkeypatch, seed, n, percent, rest):
    monkeypatch.setattr(jaccard, "REST_PAIRS", rest)
    rows = corpus(seed)
    out = jaccard._labelled(jaccard.join_documents(make_docs(rows), n, percent)).collect()
    want = {i: (s, c) for i, s, c in brute(rows, n, percent)}
    assert {r.id: (r["size"], r.component_id) for r in out} == want


def test_frequent_elements_change_no_result(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_LEAST", 2)
    rows = corpus(9)
    want = {i: c for i, _, c in brute(rows, 4, 70)}
    assert {r.id: r.component_id for r in jaccard._labelled(jaccard.join_documents(make_docs(rows), 4, 70)).collect()} == want
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    assert {r.id: r.component_id for r in jaccard._labelled(jaccard.join_documents(make_docs(rows), 4, 70)).collect()} == want


def test_a_crowd_at_middle_distance_is_not_paired(make_docs, monkeypatch):
    """Variants of one text, most of them too far apart to link: their frequent elements stand in
    many prefixes, but behind elements of their own."""
    rng = random.Random(3)
    vocabulary, pairs = [f"w{i}" for i in range(5000)], []
    base = rng.choices(vocabulary, k=150)
    rows = []
    for i in range(240):
        copy = list(base)
        for at in rng.sample(range(150), 1 if i % 40 == 0 else 5):
            copy[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy), "en", "s"))
    verify = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda p, *more: (pairs.append(p.count()), verify(p, *more))[1])
    monkeypatch.setattr(jaccard, "RUN_LEAST", 2)
    got = {r.id: r.component_id for r in jaccard._labelled(jaccard.join_documents(make_docs(rows))).collect()}
    assert got == {i: c for i, _, c in brute(rows, 4, 85)}
    assert sum(pairs) < 240 * 239 / 2 / 4


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = odd_docs.withColumn("key", F.lit(1)).withColumn("prefix", F.lit(2))
    got = jaccard._labelled(jaccard.join_documents(docs)).collect()
    assert sorted((str(r.id), r["size"], str(r.component_id)) for r in got) == sorted((str(a), b, str(c)) for a, b, c in brute(rows, 4, 85))
    assert jaccard.join_documents(odd_docs.limit(0)).count() == 0


def test_one_of_each_group_stays(make_docs, odd_docs):
    rows = corpus(5)
    docs = make_docs(rows + rows[:3]).withColumn("_id", F.lit(0))
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    want = {c for _, s, c in brute(rows, 5, 80) if s} | {i for i, s, _ in brute(rows, 5, 80) if not s}
    assert len(kept) == len(set(kept)) and set(kept) == want
    odd = jaccard.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == 10
    assert jaccard.keep_one(odd_docs.limit(0)).count() == 0


def test_word_hashes_need_the_memory_of_a_window():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(300)).encode() for _ in range(640)]
    some = sum(map(len, texts))
    assert some > 1_000_000
    tracemalloc.start()
    h, start, end, buf = words.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * some
    # the same hash wherever a word stands, in a window of its own too
    one = {buf[a:b]: x for a, b, x in zip(start.tolist(), end.tolist(), h.tolist())}
    assert all(words.word_hashes([w])[0].tolist() == [one[w]] for w in list(one)[:200])
    long = b"x" * (2 * words.WINDOW)
    assert words.word_hashes([b"a " + long + b" b"])[0].tolist() == [words.word_hashes([w])[0][0] for w in (b"a", long, b"b")]


def test_texts_go_to_python_in_batches_of_bounded_size(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    docs = spark.range(2000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("y"), 10_000)).alias("text"))

    def look(texts, n):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["bytes", "rows"])
        seen.extend(texts.mapInArrow(sizes, "bytes bigint, rows bigint").collect())
        return np.zeros(0, np.uint64)

    monkeypatch.setattr(jaccard, "frequent_elements", look)
    before = spark.conf.get(name)
    assert jaccard.join_documents(docs).count() == 2000
    assert sum(r["rows"] for r in seen) == 2000 and max(r["bytes"] for r in seen) <= common.BATCH + 20_000
    assert spark.conf.get(name) == before


def kept_bytes(spark):
    """Bytes of Spark's shuffle files and of tables in the checkpoint folder."""
    out = []
    for top, names in ((spark.conf.get("spark.local.dir"), "shuffle_"), (spark.conf.get("spark.checkpoint.dir"), "part-")):
        files = [os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs if f.startswith(names)]
        out.append(sum(os.path.getsize(f) for f in files if os.path.exists(f)))
    return out


@pytest.mark.parametrize("join", [jaccard.join_documents, jaccard.keep_one])
def test_tables_and_shuffles_go_when_they_are_not_needed(spark, make_docs, join):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10 ** 9)) for _ in range(300)) for _ in range(600)]
    docs = make_docs([(i, f"{t} {i}", "en", "s") for i, t in enumerate(texts * 2)]).cache()
    size = docs.select(F.sum(F.length("text"))).first()[0]
    before = kept_bytes(spark)
    joined = join(docs)
    time.sleep(1)
    shuffles, tables = (now - then for now, then in zip(kept_bytes(spark), before))
    assert shuffles < 0.1 * size and tables < 0.1 * size
    assert joined.count() == (1200 if join is jaccard.join_documents else 600)


def test_texts_of_far_pairs_stay_where_they_are(make_docs, monkeypatch):
    """Texts with half of their words in common share elements of their prefixes, and none is near another."""
    rng, rows = random.Random(4), []
    shared = [str(rng.randrange(10 ** 9)) for _ in range(100)]
    for i in range(120):
        rows.append((i, " ".join([*shared, *(str(rng.randrange(10 ** 9)) for _ in range(rng.choice([40, 60])))]), "en", "s"))
    rows += [(500 + i, rows[i][1] + " more", "en", "s") for i in range(10)]
    fetched, near = [], jaccard._sent

    def sent(keys):
        if keys.columns == ["a", "b"]:
            fetched.append(keys.count())
        return near(keys)

    monkeypatch.setattr(jaccard, "_sent", sent)
    monkeypatch.setattr(jaccard, "RUN_LEAST", 10 ** 9)
    got = {r.id: r.component_id for r in jaccard._labelled(jaccard.join_documents(make_docs(rows))).collect()}
    assert got == {i: c for i, _, c in brute(rows, 4, 85)}
    assert 10 <= sum(fetched) <= 200


def test_marks_bound_the_difference(spark, make_docs):
    rows = corpus(6)
    texts = make_docs([r for r in rows if shingles(r[1], 4)]).select(F.col("doc_id").alias("m"), "text")
    marks = {r.m: r for r in jaccard._marked(texts, 4).collect()}
    sets = {r.m: shingles(r.text, 4) for r in texts.collect()}
    for i in list(sets)[::3]:
        for j in sets:
            apart = [sum(((marks[i][c] ^ marks[j][c]) & (2 ** 64 - 1)).bit_count() for c in names)
                     for names in (("f0", "f1"), [f"b{k}" for k in range(jaccard.MARK // 64)])]
            assert apart[0] <= apart[1] <= len(sets[i] ^ sets[j])
