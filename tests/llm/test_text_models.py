import random

from pyspark.sql import functions as F

from ordermill.llm import common, langid, licences, registry

SF = "/root/testdata/sf0.001"

WORDS = {k: v.split() for k, v in langid.SEEDS.items()}


def corpus(seed=1, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = "de en es fr".split()[i % 4]
        said = lang if rng.random() < 0.9 else rng.choice("de en es fr".split())
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(20, 60))), said, f"h{i % 5}", lang))
    return rows


def test_languages_on_held_out_texts(make_docs):
    rows = corpus()
    truth = {r[0]: r[4] for r in rows}
    got = langid.identify(langid.document_evidence(make_docs([r[:4] for r in rows]), doc_id=F.col("doc_id"))).collect()
    right = sum(r.lang_id == truth[r.doc_id] for r in got)
    assert right >= 0.97 * len(rows) and all(r.kept for r in got)


def test_declared_host_and_suffix_decide_where_the_text_does_not(spark):
    rows = [(i, f'<html lang="{l}"><body>{t}</body></html>', f"https://h{i % 3}.site-{l}.example.{l}/{l}/x") for i, t, l, _, _ in corpus()]
    rows += [(1000, '<HTML class=x lang=fr-CA><body>la de</body>', "https://h1.site-fr.example.fr/fr/"),
             (1001, "<p>la de</p>", "https://u:p@h1.site-es.example.es:80/es/1"), (1002, None, None), (1003, "<b></b>", "nonsense")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = {r.page_id: r for r in langid.identify(langid.page_evidence(pages, page_id=F.col("page_id"))).collect()}
    assert got[1000].declared == "fr" and got[1000].lang_id == "fr"
    assert got[1001].lang_id == "es" and got[1001].domain == "example.es" and got[1001].suffix == "es/es"
    assert not got[1002].kept and not got[1003].kept


def test_registered_query_over_pages_has_all_channels(spark):
    pages = common.read_table(spark, SF, "pages")
    got = registry.queries()["op1_pages_language"](spark, SF)
    assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in pages.select("page_id").collect())
    seen = langid.page_evidence(pages).agg(*[F.count(c).alias(c) for c in ("declared", "host", "domain", "suffix")]).first()
    assert all(n > 0.5 * pages.count() for n in seen)
    assert got.where("declared_lang IS NOT NULL AND lang_id = declared_lang").count() > 0.5 * pages.count()


def test_a_source_without_a_dot_has_no_domain(make_docs):
    docs = make_docs([(1, "a", "en", "src0"), (2, "b", "en", "www.example.org")])
    assert [r.domain for r in langid.document_evidence(docs, k=F.col("doc_id")).orderBy("k").collect()] == [None, "example.org"]


def test_odd_rows_and_other_scripts(make_docs, odd_docs):
    docs = make_docs([r[:4] for r in corpus()] + [(5000, "съешь ещё этих мягких французских булок " * 5, None, None)]).union(odd_docs)
    docs = docs.withColumn("_mark", F.lit(1)).withColumn("_id", F.lit(2))
    kept = langid.keep_identified(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert 5000 not in ids and 1 in ids and ids.count(4) == 3  # id 4 of the corpus and the repeated row
    assert set(range(160)) <= set(ids)
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_nothing_declared(make_docs):
    rows = [(i, t, None, None) for i, t, _, _, _ in corpus(n=40)]
    got = langid.identify(langid.document_evidence(make_docs(rows), doc_id=F.col("doc_id"))).collect()
    assert sum(r.lang_id == "de en es fr".split()[r.doc_id % 4] for r in got) >= 38


def many_languages(n, texts):
    """(id, text, tag, host, tag) rows of ``n`` made-up languages with words of their own."""
    rng, rows = random.Random(5), []
    for k in range(n):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(30)]
        tag = "xyz"[k // 26] + chr(97 + k % 26)
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=40)), tag, "h", tag) for i in range(texts + (k < 55))]
    return rows


def test_the_languages_have_no_rank_cap(make_docs):
    rows = many_languages(60, 4)
    truth = {r[0]: r[4] for r in rows}
    got = langid.identify(langid.document_evidence(make_docs([r[:4] for r in rows]), doc_id=F.col("doc_id"))).collect()
    assert all(r.lang_id == r.text_lang == truth[r.doc_id] and r.kept for r in got) and len(got) == len(rows)


def test_copies_do_not_fill_the_sample(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 10)
    rows = [r[:4] for r in corpus(n=80)] + [(1000 + i, WORDS["en"][0] * 9, "en", "h") for i in range(3000)]
    sample = langid.training_sample(langid.document_evidence(make_docs(rows)))
    assert all(sum(lang == x for x, _ in sample) == 10 for lang in WORDS)
    assert len(set(sample)) == len(sample)
    lines = [(i, "a common line of text\n" + (f"another line {i}" if i < 40 else ""), "en", "h") for i in range(2000)]
    assert len(licences.sample_paragraphs(make_docs(lines), n=41)) == 41


FILL = ["the river runs along the old town wall", "we measured every sample twice before lunch", "copyright is a word in this sentence",
        "the license plate of the car was new", "he was granted permission to leave the software course"]


def test_licences_on_held_out_wordings(make_docs):
    model = licences.train(FILL * 40)
    wordings = {"apache-2.0": "Source code licensed under the Apache License, Version 2.0 (see NOTICE).", "mit": "Released under the MIT License, 2019",
                "gpl-3.0": "It is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Photos: licensed under CC BY-NC 4.0.",
                "cc-by-sa": "Text is licensed under CC BY-SA 4.0!", "all-rights-reserved": "(c) Somebody. All rights reserved."}
    rows = [(i, f"{FILL[0]}\n{w}\n{FILL[1]}", "en", "s") for i, w in enumerate(wordings.values())]
    rows += [(100 + i, t + "\n" + t, "en", "s") for i, t in enumerate(FILL)]
    rows += [(200, " ".join([*FILL * 20, "licensed under the Apache License Version 2.0", *FILL * 20]), "en", "s")]
    got = {r.doc_id: [x.family for x in r.licences] for r in licences.scan(make_docs(rows), model).collect()}
    for i, family in enumerate(wordings):
        assert got[i] == [family]
    assert all("unknown" in got[100 + i] or not got[100 + i] for i in range(len(FILL)))
    assert "apache-2.0" in got[200]


def test_licence_scan_of_odd_rows(odd_docs):
    model = licences.train(licences.sample_paragraphs(odd_docs))
    found = licences.scan(odd_docs.withColumn("probability", F.lit(1)), model)
    assert found.count() == odd_docs.count()
    assert all(not r.licences for r in found.collect() if r.doc_id in (1, 2, 3))
    assert licences.scan(odd_docs.limit(0), model).count() == 0
    assert licences.sample_paragraphs(odd_docs.limit(0)) == []


def families(model, text):
    return [x["family"] for x in licences._scan([licences.fold(text)], model)[0]]


def test_every_family_that_a_line_names_is_reported():
    model = licences.train(FILL * 40)
    assert families(model, "released under the MIT License or licensed under the Apache License Version 2.0") == ["mit", "apache-2.0"]
    assert families(model, "licensed under CC BY 4.0, all rights reserved") == ["cc-by", "all-rights-reserved"]
    assert families(model, "licensed under CC BY-SA 4.0 and CC BY 4.0 and released under the GPL v3") == ["cc-by-sa", "cc-by", "gpl-3.0"]
    for family, notices in licences.TEMPLATES.items():  # relatives share words, not notices
        assert all(families(model, t) == [family] for t in notices)
    assert families(model, "licensed under the GNU General Public License version 2 " * 3) == ["gpl-2.0"] * 3


def test_notices_wrapped_over_lines():
    model = licences.train(FILL * 40)
    lines = "licensed under a Creative Commons", "Attribution-NonCommercial 4.0 International License"
    assert families(model, f"{FILL[0]}\n# {lines[0]}\n# {lines[1]}\n\n{FILL[1]}") == ["cc-by-nc"]
    assert families(model, "x all rights\nreserved") == ["all-rights-reserved"]
    assert "all-rights-reserved" not in families(model, "x all rights\n\nreserved")
    for family, notices in licences.TEMPLATES.items():
        for words in map(str.split, notices):
            for k in range(1, len(words)):
                text = " ".join([*FILL, *words[:k]]) + "\n" + " ".join([*words[k:], *FILL])
                assert {family} == set(families(model, text)) - {"unknown"}, text


def held_out_corpus(seed):
    """Texts with at most one notice each, in wordings that training does not make: other words around
    it, other case and punctuation, one word of it changed, or broken over lines."""
    rng, rows = random.Random(seed), []
    around = [w for t in FILL for w in t.split()] + "see also our page for details of use and sharing among all users".split()
    some = lambda a, b: [rng.choice(around) for _ in range(rng.randint(a, b))]
    for _ in range(12):
        for family, notices in licences.TEMPLATES.items():
            for t in notices:
                words = t.split()
                if len(words) > 6:
                    words[rng.randrange(1, len(words) - 1)] += rng.choice(["", ",", ".", "'s"])
                words = [w.upper() if rng.random() < 0.1 else w for w in words]
                if rng.random() < 0.3:
                    words[rng.randrange(len(words) - 1)] += "\n//"
                rows.append((" ".join([*some(0, 40), *words, *some(0, 40)]), family))
        rows += [(" ".join(some(5, 90)), None) for _ in range(40)]
    return rows


def test_recall_and_precision_on_held_out_wordings():
    model = licences.train(FILL * 40)
    right = found = missed = 0
    for text, family in held_out_corpus(21):
        got = set(families(model, text)) - {"unknown"}
        found += len(got)
        right += family in got
        missed += family is not None and family not in got
    assert right / (right + missed) >= 0.95 and right / found >= 0.95, (right, found, missed)


def test_the_regression_names_the_families():
    """A family whose weights are taken away is not reported, however well its notice is contained."""
    model = licences.train(FILL * 40)
    text = "this file is licensed under the MIT License"
    assert families(model, text) == ["mit"]
    mit = licences.FAMILIES.index("mit")
    model.weights[:, mit], model.bias[mit] = 0, -50
    assert "mit" not in families(model, text)
    assert 0 < model.named < 0.3 and licences.MIN_PROBABILITY <= model.doubt < 1
