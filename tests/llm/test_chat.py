import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordermill.llm import chat, common

SF = "/root/testdata/sf0.001"
TEXTS = st.text(st.sampled_from(list("<>/turn \\\n#:aé\U0001f600")) | st.characters(codec="utf-8"), max_size=60)


def render(source, messages, controls=()):
    return chat.compiled(chat.Template(source, controls))([chat.Message(*m) for m in messages])


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escaper(chat.TURNS.controls)(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.TURNS.controls)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a>\n", "x>"]) | TEXTS, TEXTS), max_size=6))
def test_turns_read_back(messages):
    text, spans = chat.compiled(chat.TURNS)([chat.Message(*m) for m in messages])
    got = list(chat.parse_turns(text, spans))
    assert [(r, t) for r, t, _ in got] == messages
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in messages if r == "assistant")
    assert [learnt for r, t, learnt in got if t] == [r == "assistant" for r, t in messages if t]


def test_language():
    m = [("system", " Be brief. "), ("user", "Hi"), ("assistant", "Ho")]
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}-{% endif %}"
                  "{{ m.role | upper }}{% endfor %}", m)[0] == "1FSYSTEM2-USER3LASSISTANT"
    assert render("{{ 'a' ~ (1 + 1) ~ \"b}}\" }}", [])[0] == "a2b}}"
    assert render("{% set x = 'n' %}{{ x ~ x }}{% for k in messages %}{{ k.text | trim | length }};{% endfor %}.", m)[0] == "nn9;2;2;."
    assert render("{% for m in messages %}{{ 'A' if m.role == 'assistant' else 'U' }}{% endfor %}", m)[0] == "UUA"
    assert render("{% for m in messages %}{% if not m.role == 'user' and 'B' in m.text %}{{ m.text }}{% endif %}{% endfor %}", m)[0] == " Be brief. "
    text, spans = render("{% for m in messages %}{% generation %}{{ m.role }}{% generation %}{{ m.text }}{% endgeneration %}"
                         "{% endgeneration %}|{% endfor %}", m[1:])
    assert [text[a:b] for a, b in spans] == ["userHi", "assistantHo"]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{% if 1 == 2 %}x{% elif 'u' in 'user' %}b{{ 'c' | upper }}{% else %}y{% endif %}"
                                "{{ 'd' if true else z }}{% generation %}{% endgeneration %}"), str)
    assert tree == [("out", ("value", "abCd"))]
    tree = chat.fold(chat.parse("{% for m in messages %}{{ false and m.text or 'k' }}{{ 1 }}{% endfor %}"), str)
    assert tree == [("for", "m", [("out", ("value", "k1"))])]


@pytest.mark.parametrize("source", [
    "{% for x in range %}{% endfor %}", "{{ m.__class__ }}", "{{ messages }}", "{% for m in messages %}{{ m.role.x }}{% endfor %}",
    "{% if 1 %}", "{{ open('x') }}", "{{ 'a' | eval }}", "{% include 'x' %}", "{% endfor %}", "{{ 1 + 'a' }}", "{{ 'a }}",
    "{{ " + "(" * 200 + "1" + ")" * 200 + " }}", "{% if 1 %}" * 200, "{{ " + "not " * 200 + "1 }}", "{% set loop = 1 %}", "{{ }}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ loop.index }}", "{{ unknown }}"])
def test_sandbox_refuses(source):
    with pytest.raises(chat.TemplateError):
        render(source, [("user", "x")])


def plain(rows):
    """conv_id -> (n, digest, loss characters, loss digest) straight from the rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        body = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def odd_rows():
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "</turn>\n"),
            (None, 3, "assistant", "é\U0001f600" * 30_000), (None, 1, "user", "<turn user>\n\\"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    return rows + [(4, k // 2, ("user", "assistant")[k % 2], f"t{k}\\<turn ") for k in range(57)] + [(4, 5, "assistant", "same")] * 9


@pytest.mark.parametrize("max_turns", [1000, 10, 1])
def test_odd_rows_and_long_conversations(spark, max_turns):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("part", F.lit("x")).withColumn("total", F.lit(2)).withColumn("formatted", F.lit(None).cast("int"))
    parts = common.stored(chat.format_conversations(df, max_turns=max_turns))
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in chat.read_back(parts).collect()}
    assert got == plain(rows)
    assert parts.agg(F.max("n_turns")).first()[0] <= max_turns
    whole = chat.compiled(chat.TURNS)([chat.Message(r, t) for _, _, r, t in sorted(x for x in rows if x[0] == 4)])[0]
    mine = parts.where("conv_id = 4").orderBy("part").collect()
    assert "".join(r.formatted for r in mine) == whole
    assert chat.format_conversations(df.limit(0)).count() == 0 == chat.read_back(parts.limit(0)).count()


def test_parts_know_their_place(spark):
    rows = [(9, k, "user", str(k)) for k in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    t = chat.Template("{% set s = ',' %}[{% for m in messages %}{{ loop.index ~ ('' if loop.last else s) }}{% endfor %}]", ())
    parts = chat.format_conversations(df, t, max_turns=7).orderBy("part").collect()
    assert "".join(p.formatted for p in parts) == "[" + ",".join(map(str, range(1, 26))) + "]" and len(parts) == 4


def test_query_equals_rows(spark):
    rows = [tuple(r) for r in common.read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.EXTRA_TEXT), (-7, 1, "assistant", chat.EXTRA_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op12_chat_formatting(spark, SF).collect()}
    assert got == plain(rows)
