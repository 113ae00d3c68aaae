import os
import subprocess
import sys

import corpus_pipeline
from ordermill.llm import common, registry
from ordermill.testing.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_rows(spark):
    docs = common.read_table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert len(corpus_pipeline.STAGES) == 5
    assert sizes[0] == n and n > sizes[1] == sizes[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_stages_take_an_empty_table(spark):
    docs = common.read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.source) for r in docs.collect()}
        docs = common.stored(stage(spark, docs, SF))
        assert docs.columns == odd_docs.columns
        rows = docs.collect()
        assert rows and {(r.doc_id, r.source) for r in rows} <= before, name
        if name == "n-gram Jaccard join":  # repeated rows are one
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert all(0 < r.length <= 4096 and r.offset + r.length <= 4096 for r in packed)


def test_oracles(spark):
    con = duckdb_connection(SF)
    for name, sql in registry.oracle_sql().items():
        assert compare(spark, registry.queries()[name], sql, SF, con)["ok"], name


def test_entry_has_all_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys; sys.modules['ordermill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert len(e.queries()) > 40 and 'pipeline' not in e.queries(); e.oracle_sql()")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
