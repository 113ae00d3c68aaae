import hashlib
import random
import zlib

import numpy as np

from ordermill.llm import common, wordruns

SF = "/root/testdata/sf0.001"


def brute(words, least=24):
    """Every maximal stretch of every period, kept where no smaller period spans the same words."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted([(i, j - i, q) for (i, j), q in best.items()], key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, least=24):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, least)
    drop = {k for i, m, q in runs for k in range(i + q, i + m)}
    top = None
    for i, m, q in runs:
        if top is None or m * top[2] > top[1] * q:
            top = (i, m, q)
    lines = "".join(f"{i},{m},{q}\n" for i, m, q in runs)
    text = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (doc_id, n, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def made_text(rng):
    words = rng.choice([1, 2, 3, 5, 60])
    out = [rng.randrange(words) for _ in range(rng.choice([0, 1, 23, 24, 100, 300]))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(words) for _ in range(rng.randrange(1, 25))]
        out += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit) + 1)]
    return out


def test_runs_equal_brute_force_on_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = [made_text(rng) for _ in range(rng.choice([1, 4, 9]))]
        least = rng.choice([24, 24, 7, 10])
        ids, doc, ends = wordruns._numbered([(d, [b"%d" % w for w in t]) for d, t in enumerate(texts)])
        want, base = [], 0
        for t in texts:
            want += [(base + i, base + i + m, q) for i, m, q in brute(t, least)]
            base += len(t)
        assert [tuple(r) for r in wordruns.runs_of(ids, doc, ends, least).tolist()] == want


def test_structured_texts():
    fib = [0], [0, 1]
    while len(fib[1]) < 1500:
        fib = fib[1], fib[1] + fib[0]
    thue = [bin(i).count("1") & 1 for i in range(1024)]
    ladder = [w for k in range(1, 40) for w in range(k)]
    square = list(range(200)) * 2 + list(range(200, 260)) * 5
    for t in (fib[1], thue, ladder, square, [0] * 777, [0, 1] * 300 + [0] * 300):
        ids = np.array(t, np.int64)
        got = wordruns.runs_of(ids, np.zeros(len(t), np.int64), np.array([len(t)]))
        assert [(i, j - i, q) for i, j, q in got.tolist()] == brute(t)


def test_a_wrong_fingerprint_is_found_out(monkeypatch):
    """With fingerprints that take everything for equal, verification sends each text the direct way."""
    monkeypatch.setattr(wordruns.Words, "equal", lambda self, x, q, n: np.ones(len(x), bool))
    rng = random.Random(3)
    for _ in range(20):
        t = made_text(rng)
        ids, doc, ends = wordruns._numbered([(0, [b"%d" % w for w in t])])
        assert [(i, j - i, q) for i, j, q in wordruns.runs_of(ids, doc, ends).tolist()] == brute(t)


def test_grammar_pairs_what_repeats():
    t = np.array([1, 2, 3, 4] * 16 + [9, 8, 1, 2], np.int64)
    (left, size), (name, place), (rest, _) = wordruns.grammar(t, np.zeros(len(t), np.int64))
    assert len(rest) <= 5 and size.max() >= 32
    for k in range(len(size)):  # every derivation position of a nonterminal shows the same words
        spans = {tuple(t[p:p + size[k]].tolist()) for p in place[name == k].tolist()}
        assert len(spans) == 1 and 0 < left[k] < size[k] and (name == k).sum() > 1


def test_small_slices_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(map(str, made_text(rng)))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, wordruns.find_runs(df).collect()))
    monkeypatch.setattr(wordruns, "SLICE", 50)
    monkeypatch.setattr(wordruns, "PAIRS", 37)
    assert sorted(map(tuple, wordruns.find_runs(df).collect())) == want


def test_query_equals_plain_python(spark):
    docs = common.read_table(spark, SF, "documents")
    want = {plain_row(r.doc_id, r.text if len(r.text) < 20000 else None) for r in docs.collect()}
    short = docs.withColumn("text", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(length(text) < 20000, text, null)"))
    got = set(map(tuple, wordruns.summary(wordruns.find_runs(short, prepare=wordruns.planted)).collect()))
    assert got == want and any(r[2] for r in got)


def test_odd_rows_and_names(spark, odd_docs):
    from pyspark.sql import functions as F
    odd = odd_docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    rows = wordruns.summary(wordruns.find_runs(odd)).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    for k in (1, 2, 3):
        assert (by_id[k].n_words, by_id[k].n_runs, by_id[k].start, by_id[k].runs_sha256, by_id[k].collapsed_sha256) == (0, 0, None, empty, empty)
    assert (by_id[7].length, by_id[7].period, by_id[7].exponent_milli) == (60_000, 1, 60_000_000)
    assert by_id[7].collapsed_sha256 == hashlib.sha256(b"lang").hexdigest()
    assert by_id[8].n_words == 1 and sum(r.doc_id is None for r in rows) == 2
    assert wordruns.find_runs(odd_docs.limit(0)).count() == 0
