import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, lang, source) rows."""
    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls everywhere, empty and blank texts, repeated rows, one id with two texts, a long text."""
    base = "the of and to in a is that for it as was with be by on not he his but at are this have "
    return make_docs([
        (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, base * 3, "en", "s"), (4, base * 3, "en", "s"),
        (5, base * 3 + "extra", "en", None), (6, "un deux trois", "fr", "t"), (6, "eins zwei drei vier fünf", "de", "t"),
        (None, base, None, "t"), (None, None, None, None), (7, "lang " * 60_000, "de", "t"), (8, "x" * 200_000, "en", "t"),
        (9, "漢字 かな ΣΑΣ İstanbul \U0001f600", "xx", "u")])
