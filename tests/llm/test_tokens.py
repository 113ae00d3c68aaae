import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ordermill.llm import common, packing, tokenfile  # noqa: E402
from ordermill.llm import encoding  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(tok, text, end):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 500)  # generations change often
    rng = random.Random(2)
    bits = list(" \n\t \x1c\x85\xa0'sStabcÉéßñ漢1²9.,!?<|>_-́​ΣİSZ") + [
        "<|endoftext|>", "'ll", " \n ", "<|startoftext|>", "Ⅷ", " abc. ", "Ab, ", "long" * 40]
    tok, enc = Tokenizer.from_file(path), encoding.Encoder(path)
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    for i in range(0, len(texts), 50):
        for text, got in zip(texts[i:i + 50], enc.encode(texts[i:i + 50])):
            assert got == ids_of(tok, text, 0)[:-1].tobytes(), ascii(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_the_table_of_pieces_is_arrays_of_bounded_bytes(path, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 20_000)
    rng = random.Random(6)
    tok, enc = Tokenizer.from_file(path), encoding.Encoder(path)
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(400)) for _ in range(4)]
        assert enc.encode(texts) == [ids_of(tok, t, 0)[:-1].tobytes() for t in texts]
        assert enc.keys.nbytes + enc.flat.nbytes + enc.many.nbytes + enc.uses.nbytes < 20_000
        assert len(enc.keys) == len(enc.many) == len(enc.uses) and enc.flat.size == enc.many.sum()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_one_table_serves_all_tasks_of_a_worker(path, monkeypatch):
    """The next task of a worker finds the pieces of the one before in the table."""
    import pyarrow as pa
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": [" ".join(words[i::40]) for i in range(40)]})
    first = [ids for _, rows in encoding.encoded([batch], path) for ids in rows]
    met = []
    fresh = encoding.Encoder._fresh
    monkeypatch.setattr(encoding.Encoder, "_fresh", lambda self, pieces: met.extend(pieces) or fresh(self, pieces))
    assert [ids for _, rows in encoding.encoded([batch], path) for ids in rows] == first and not met


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_in_other_case_and_composing_marks(path):
    tok, enc = Tokenizer.from_file(path), encoding.Encoder(path)
    texts = [f"a {t.upper()} b" for t in enc.added] + ["a H\u0331J\u030c T\u0308x W\u030a", "Plain WORDS, Here. ÀÉ Ł", "", " "]
    assert enc.encode(texts) == [ids_of(tok, t, 0)[:-1].tobytes() for t in texts]


def test_token_files_hold_every_document_in_order(spark, odd_docs):
    folder = tokenfile.write_tokens(odd_docs.withColumn("kind", F.lit(1)), BYTE, common.shared_folder(spark, "tokens"))
    rows = sorted(tokenfile.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    tok, texts = Tokenizer.from_file(BYTE), [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted((i is not None, i or 0, len(ids_of(tok, t, 0)), zlib.crc32(ids_of(tok, t, 0).tobytes())) for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_negative_and_large_ids_and_empty_tables(spark, make_docs):
    docs = make_docs([(-5, "a", "en", "s"), (2 ** 62 + 3, "b", "en", "s"), (-2 ** 63, "c", "en", "s")])
    folder = tokenfile.write_tokens(docs, BYTE, common.shared_folder(spark, "tokens"))
    assert [r.doc_id for r in tokenfile.read_tokens(spark, folder).orderBy("start").collect()] == [-2 ** 63, -5, 2 ** 62 + 3]
    folder = tokenfile.write_tokens(docs.limit(0), BYTE, common.shared_folder(spark, "tokens"))
    assert tokenfile.read_tokens(spark, folder).count() == 0


def test_fullest_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums)
        assert all(k <= counts[n] for n, k in got.items())


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 4096): rng.randint(1, 5000) for _ in range(300)}
    plan = packing.plan_bins(counts)
    used = {}
    for repeat, chosen in plan:
        assert sum(n * k for n, k in chosen.items()) <= 4096
        for n, k in chosen.items():
            used[n] = used.get(n, 0) + repeat * k
    assert used == counts
    total, bins = sum(n * c for n, c in counts.items()), sum(r for r, _ in plan)
    assert bins <= 1.03 * max(-(-total // 4096), sum(c for n, c in counts.items() if n > 2048))


def test_packing_of_odd_rows(odd_docs):
    rows = packing.pack_documents(odd_docs.withColumn("length", F.lit("x"))).toPandas()
    tok = Tokenizer.from_file(WORD)
    want = sorted(zlib.crc32(ids_of(tok, r.text, 1)[k:k + 4096].tobytes())
                  for r in odd_docs.collect() for k in range(0, len(ids_of(tok, r.text, 1)), 4096))
    assert sorted(rows.ids_crc32) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
        assert g.length.sum() <= 4096
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_many_files_are_read_by_many_tasks(spark, make_docs, monkeypatch):
    """A few small rows name the files; their tasks are stated, so AQE does not merge them into one."""
    from ordermill.llm import warc
    monkeypatch.setattr(tokenfile, "TASK_BYTES", 2000)
    docs = make_docs([(i, f"word{i} and more text " * 30, "en", "s") for i in range(400)]).repartition(16)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # many files, as of large tables
    try:
        folder = tokenfile.write_tokens(docs, BYTE, common.shared_folder(spark, "tokens"))
        archive = warc.write_archive(pages, common.shared_folder(spark, "warc"))
    finally:
        spark.conf.set(merge, "true")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and tokenfile.shards(spark, folder).count() > 1
    read = tokenfile.read_tokens(spark, folder).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > 1 and read.count() == 400
    index = warc.write_index(spark, archive)
    assert index.select(F.input_file_name().alias("f")).distinct().count() > 1
    got = warc.read_records(index).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() > 1 and got.count() == 400


def test_two_files_of_a_shard_are_refused(spark, make_docs):
    old = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        docs = make_docs([(i, "a b c", "en", "s") for i in range(40)])
        folder = tokenfile.write_tokens(docs, BYTE, common.shared_folder(spark, "tokens"))
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", old)
    with pytest.raises(Exception, match="several files"):
        tokenfile.read_tokens(spark, folder).count()


def test_slices_hold_bounded_bytes():
    import pyarrow as pa
    from ordermill.llm.common import slices
    texts = pa.array(["x" * n for n in (5, 0, 3, 100, 1, 1, 1, 200)] + [None, "a", "b"])
    got = list(slices(texts, 4, 10))
    assert got == [(0, 3), (3, 1), (4, 3), (7, 1), (8, 3)] and list(slices(texts.slice(0, 0), 4, 10)) == []
