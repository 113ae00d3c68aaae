import hashlib
import random
import re

from pyspark.sql import functions as F

from ordermill.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_rules_on_random_texts(make_docs):
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "x_y%", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "+1 (555) 123-4567", "+", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "4111111111111112", " ", "-", "9", "0", "é", "\U0001f600", "foo.bar@x-y.co.uk.", "c_d@e.f", "\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14))), "en", "s") for i in range(1500)]
    got = pii.find_spans(make_docs(rows)).select("doc_id", pii._listed(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))).alias("s"))
    want = {i: base(t) for i, t, _, _ in rows}
    assert {r.doc_id: r.s for r in got.collect()} == want


def test_long_runs_are_fast_and_odd_rows_defined(make_docs, odd_docs):
    docs = make_docs([(31, "1" * 200_000, "en", "s"), (32, "a" * 200_000 + "@", "en", "s"), (33, "1." * 8_000, "en", "s"),
                      (34, "+1 " + "2-" * 50_000, "en", "s"), (35, "1 " * 50_000, "en", "s")]).union(odd_docs)
    rows = pii.find_spans(docs.withColumn("found", F.lit(1))).collect()
    assert len(rows) == docs.count()
    assert [len(r.spans) for r in rows if r.doc_id == 33] == [2_000]
    assert all(r.spans == [] for r in rows if not r.text)


def test_added_kinds_need_checksum_or_context(make_docs):
    docs = make_docs([(1, "my IBAN is DE89 3704 0044 0532 0130 00 EUR", "en", "s"), (2, "IBAN DE88 3704 0044 0532 0130 00", "en", "s"),
                      (3, "SSN 123-45-6789", "en", "s"), (4, "part 123-45-6789", "en", "s")])
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert got == {1: [("iban", 11, 38)], 2: [], 3: [("ssn", 4, 15)], 4: []}
    scores = {r.doc_id: r.spans[0].score for r in pii.find_spans(docs).where("size(spans) > 0").collect()}
    assert scores[1] == 1.0


def test_redact_changes_spans_only(make_docs, odd_docs):
    docs = make_docs([(1, "é mail x@y.org, call +1 555 123 4567 now", "en", "s"), (2, "clean", "en", "s"), (3, None, "en", "s")])
    docs = docs.withColumn("_spans", F.lit("mine"))
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "é mail [EMAIL], call [PHONE] now"
    assert out[2].text == "clean" and out[3].text is None and out[1]._spans == "mine"
    assert pii.redact(odd_docs).count() == odd_docs.count()
    assert pii.redact(odd_docs.limit(0)).count() == 0


def test_digest_column(spark):
    rows = pii.op9_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
        assert r.n_email == base(texts[r.doc_id]).count("email:")
