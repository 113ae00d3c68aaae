import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from ordermill.llm import common, warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a.example/x y\r\nz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.example", None), (4, "u", ""),
        (5, "u", "big" * 2_000_000), (None, "u", "<p>é</p>"), (6, "u", "\r\n\r\nContent-Length: 5\r\n\r\n"), (9, "u", "one"), (8, "u", "one"),
        (10, "u", "x"), (10, "u", "x")]


def archived(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_first", F.lit(0)).withColumn("_sha", F.lit("s"))
    return warc.write_archive(df, common.shared_folder(spark, "warc"), **options)


def test_round_trip(spark):
    index = warc.write_index(spark, archived(spark, ROWS))
    got = warc.read_records(index, payload=True).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), str(u).replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), len((h or "").encode()),
                   base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, u, h in ROWS)
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.digest) for r in got) == want
    refers = {r.page_id: r.refers_to for r in got}
    assert refers == {1: None, 2: 1, 3: None, 4: 3, 5: None, None: None, 6: None, 8: None, 9: 8, 10: None}
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(r.payload == texts[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_ranges_and_files(spark):
    folder = archived(spark, [(i, "u", f"text {i} " * 200) for i in range(300)])
    index = warc.write_index(spark, folder)
    some = index.where("page_id % 7 = 0")
    assert warc.read_records(some, gap=0, size=100).count() == 43
    assert sorted(r.page_id for r in warc.read_records(some).collect()) == list(range(0, 300, 7))
    files = spark.read.format("binaryFile").load(folder).where("path like '%part-%'").collect()
    raw = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == 300


def test_small_payloads_can_stay_responses(spark):
    got = warc.read_records(warc.write_index(spark, archived(spark, ROWS, min_revisit=4))).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {2}


def test_a_record_whose_length_has_a_high_byte(spark):
    index = warc.write_index(spark, archived(spark, [(1, "u", "ab" * (9 << 20)), (2, "u", "c")]))
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_records(index).collect()) == [(1, 18 << 20), (2, 1)]


def test_no_pages(spark):
    index = warc.write_index(spark, archived(spark, ROWS[:1]))
    assert warc.read_records(index.limit(0)).count() == 0
    folder = warc.write_archive(spark.createDataFrame([], SCHEMA), common.shared_folder(spark, "warc"))
    assert warc.read_records(warc.write_index(spark, folder)).count() == 0
