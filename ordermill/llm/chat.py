"""Chat formatting with compiled templates.

A template is text with ``{{ expression }}`` and ``{% statement %}``:

* ``for NAME in messages`` ... ``endfor``; inside, ``NAME.role``, ``NAME.text``, ``NAME.turn``,
  ``loop.index`` (from 1), ``loop.first`` and ``loop.last``;
* ``if`` / ``elif`` / ``else`` / ``endif``; ``set NAME = expression``;
* ``generation`` ... ``endgeneration`` marks what the model is to learn;
* expressions: string and integer literals, names, ``~`` (join), ``+``, ``==``, ``!=``, ``<``, ``>``, ``in``, ``not``,
  ``and``, ``or``, ``A if B else C``, parentheses, filters ``escape upper lower trim length``.

It is a sandbox: names come from the message and the template alone, there is no call, no attribute
besides those above, and the only loop is the one over messages.  :func:`compiled` parses a template
into a syntax tree, folds constants (operators on literals, filters, conditions, neighbouring
texts) and makes one Python closure per node; :func:`format_conversations` runs them in tasks.

**Escaping.**  ``escape`` puts a backslash before every backslash and one after the first character
of every control string, so that formatted texts hold no control string of their own;
:func:`unescape` drops it again.  The control strings are the template's ``controls``.

**Scale.**  The turns of a conversation meet in one task and make one output row, if they are at most
``MAX_TURNS``.  Longer conversations are ranked by the distributed ranking (no single-task window) and
cut into parts of ``MAX_TURNS`` turns, formatted apart with the right ``loop`` values; the parts in order
are the conversation.  A digest over a whole conversation reads its parts one after another, as
SHA-256 must, and holds one row at a time.

Defined results: a null text or role is the empty string; turns come in the order of turn (nulls
first), then role and text (as rows), so repeated rows are formatted each; a null conversation id is one conversation; texts
are used whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.ranking import ranked

from .common import read_table, stored

MAX_TURNS = 1000  # turns of one output row

# ------------------------------------------------------------------------------ parsing

_INSIDE = r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^"'])*?)"""  # a literal may hold the end mark
_TAG = re.compile(r"\{\{" + _INSIDE + r"\}\}|\{%" + _INSIDE + r"%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~+<>()|.]))""", re.S)
_WORDS = {"and", "or", "not", "in", "if", "else"}
_STRING_ESCAPES = {"n": "\n", "t": "\t"}
FILTERS = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}
FIELDS = {"role", "text", "turn"}
LOOP = {"index", "first", "last"}
DEPTH = 50  # of nested expressions and statements


class TemplateError(ValueError):
    """The template is not in the language."""


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
        at = m.end()
        string, number, name, mark = m.groups()
        if string is not None:
            out.append(("value", re.sub(r"\\(.)", lambda x: _STRING_ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("value", int(number)))
        elif name in ("true", "false"):
            out.append(("value", name == "true"))
        else:
            out.append(("name" if name is not None and name not in _WORDS else "mark", name or mark))
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *marks):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def choice(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("expression too deep")
        node = self.level(0)
        if self.take("if"):
            test = self.level(0)
            if not self.take("else"):
                raise TemplateError("an else is missing")
            node = ("choice", test, node, self.choice())
        self.depth -= 1
        return node

    # binary operators from loose to tight
    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "in"), ("~", "+"))

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.filtered()
        if k == 2 and self.take("not"):
            self.depth += 1
            if self.depth > DEPTH:
                raise TemplateError("expression too deep")
            node = ("not", self.level(2))
            self.depth -= 1
            return node
        node = self.level(k + 1)
        while mark := self.take(*self.LEVELS[k]):
            node = ("binary", mark, node, self.level(k + 1))
        return node

    def filtered(self):
        if self.take("("):
            node = self.choice()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            node = ("value", self.need("value"))
        else:
            node = ("name", self.need("name"), self.need("name") if self.take(".") else None)
        while self.take("|"):
            name = self.need("name")
            if name != "escape" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node


def parse(source: str) -> list:
    """The syntax tree of a template: a list of statement nodes."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces += [("text", source[at:m.start()]), ("show", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", source[at:]))
    pieces = [p for p in pieces if p != ("text", "")]
    if any(kind == "text" and ("{{" in body or "{%" in body) for kind, body in pieces):
        raise TemplateError("a tag is not closed")
    place = 0

    def block(depth: int, *ends: str):
        nonlocal place
        if depth > DEPTH:
            raise TemplateError("statements too deep")
        nodes = []
        while place < len(pieces):
            kind, body = pieces[place]
            place += 1
            if kind == "text":
                nodes.append(("out", ("value", body)))
                continue
            if kind == "show":
                nodes.append(("out", _Expression(body).whole()))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return nodes, word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
                if not m or m[1] in _WORDS | {"loop", "messages"}:
                    raise TemplateError("for NAME in messages is the only loop")
                nodes.append(("for", m[1], block(depth + 1, "endfor")[0]))
            elif word == "if":
                arms, word = [], "elif"
                while word == "elif":
                    test = _Expression(rest).whole()
                    body, word, rest = block(depth + 1, "elif", "else", "endif")
                    arms.append((test, body))
                other = block(depth + 1, "endif")[0] if word == "else" else []
                nodes.append(("if", arms, other))
            elif word == "generation":
                nodes.append(("generation", block(depth + 1, "endgeneration")[0]))
            elif word == "set":
                name, found, value = rest.partition("=")
                if not found or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name) or name.strip() in _WORDS | {"loop", "messages"}:
                    raise TemplateError("set NAME = expression")
                nodes.append(("set", name.strip(), _Expression(value).whole()))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return nodes, None, None

    return block(0)[0]


# -------------------------------------------------------------------- constant folding

_BINARY = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "+": operator.add,
           "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: _text(a) in _text(b)}


def _text(value) -> str:
    return value if isinstance(value, str) else str(value)


def _apply(name: str, value, escape: Callable[[str], str]):
    return escape(_text(value)) if name == "escape" else FILTERS[name](_text(value))


def fold_expression(node, escape):
    """The expression with every part that needs no message computed."""
    kind = node[0]
    if kind in ("value", "name"):
        return node
    parts = [fold_expression(x, escape) if isinstance(x, tuple) else x for x in node[1:]]
    known = [x[0] == "value" for x in parts if isinstance(x, tuple)]
    if kind == "binary" and parts[0] in ("and", "or") and known[0]:
        first, second = parts[1], parts[2]
        return second if bool(first[1]) == (parts[0] == "and") else first
    if kind == "choice" and known[0]:
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("binary", "filter", "not") and all(known):
        try:
            if kind == "not":
                return ("value", not parts[0][1])
            if kind == "filter":
                return ("value", _apply(parts[0], parts[1][1], escape))
            return ("value", _BINARY[parts[0]](parts[1][1], parts[2][1]))
        except TypeError as err:
            raise TemplateError(str(err)) from err
    return (kind, *parts)


def fold(nodes: list, escape) -> list:
    """The tree with constant expressions computed, decided branches taken, empty statements
    dropped and neighbouring texts joined."""
    out = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            value = fold_expression(node[1], escape)
            if value[0] == "value":
                text = _text(value[1])
                if out and out[-1][0] == "out" and out[-1][1][0] == "value":
                    text = out.pop()[1][1] + text
                if text:
                    out.append(("out", ("value", text)))
            else:
                out.append(("out", value))
        elif kind == "for":
            out.append(("for", node[1], fold(node[2], escape)))
        elif kind == "generation":
            body = fold(node[1], escape)
            out += [("generation", body)] if body else []
        elif kind == "set":
            out.append(("set", node[1], fold_expression(node[2], escape)))
        else:
            arms, other = [], node[2]
            for test, body in node[1]:
                test = fold_expression(test, escape)
                if test[0] != "value":
                    arms.append((test, fold(body, escape)))
                elif test[1]:
                    other = body
                    break
            other = fold(other, escape)
            if arms:
                out.append(("if", arms, other))
            else:
                for n in other:
                    if n[0] == "out" and n[1][0] == "value" and out and out[-1][0] == "out" and out[-1][1][0] == "value":
                        n = ("out", ("value", out.pop()[1][1] + n[1][1]))
                    out.append(n)
    return out


# ---------------------------------------------------------------------------- closures

@dataclass
class Message:
    role: str
    text: str
    turn: object = None


class _Scope(dict):
    """Names in use: the loop's message, loop values, ``set`` names."""


def _expression(node, escape) -> Callable:
    kind = node[0]
    if kind == "value":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name, field = node[1], node[2]
        if field is None:
            def plain(scope):
                if name not in scope or isinstance(scope[name], (Message, tuple)):
                    raise TemplateError(f"no value {name!r}")
                return scope[name]
            return plain
        if name == "loop":
            if field not in LOOP:
                raise TemplateError(f"no value loop.{field}")
            which = ("index", "first", "last").index(field)

            def of_loop(scope):
                if "loop" not in scope:
                    raise TemplateError("loop outside a for")
                return scope["loop"][which]
            return of_loop
        if field not in FIELDS:
            raise TemplateError(f"no value {name}.{field}")
        read = operator.attrgetter(field)

        def of_message(scope):
            message = scope.get(name)
            if not isinstance(message, Message):
                raise TemplateError(f"no message {name!r}")
            return read(message)
        return of_message
    if kind == "not":
        inner = _expression(node[1], escape)
        return lambda scope: not inner(scope)
    if kind == "filter":
        inner, name = _expression(node[2], escape), node[1]
        if name == "escape":
            return lambda scope: escape(_text(inner(scope)))
        use = FILTERS[name]
        return lambda scope: use(_text(inner(scope)))
    if kind == "choice":
        test, yes, no = (_expression(x, escape) for x in node[1:])
        return lambda scope: yes(scope) if test(scope) else no(scope)
    a, b = _expression(node[2], escape), _expression(node[3], escape)
    if node[1] == "and":
        return lambda scope: a(scope) and b(scope)
    if node[1] == "or":
        return lambda scope: a(scope) or b(scope)
    use = _BINARY[node[1]]
    return lambda scope: use(a(scope), b(scope))


class _Output:
    """Text so far and the marked spans, in code points."""

    def __init__(self):
        self.parts, self.size, self.spans, self.open = [], 0, [], 0

    def add(self, text: str):
        self.parts.append(text)
        self.size += len(text)


def _statement(node, escape, loop) -> Callable:
    kind = node[0]
    if kind == "out":
        if node[1][0] == "value":
            text = node[1][1]
            return lambda scope, out: out.add(text)
        value = _expression(node[1], escape)
        return lambda scope, out: out.add(_text(value(scope)))
    if kind == "set":
        name, value = node[1], _expression(node[2], escape)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "generation":
        body = _block(node[1], escape, loop)

        def generation(scope, out):
            start, out.open = out.size, out.open + 1
            body(scope, out)
            out.open -= 1
            if not out.open and out.size > start:
                out.spans.append((start, out.size))
        return generation
    if kind == "if":
        arms = [(_expression(t, escape), _block(b, escape, loop)) for t, b in node[1]]
        other = _block(node[2], escape, loop)

        def branch(scope, out):
            for test, body in arms:
                if test(scope):
                    return body(scope, out)
            return other(scope, out)
        return branch
    if loop:
        raise TemplateError("one loop cannot be inside another")
    name, body = node[1], _block(node[2], escape, True)

    def repeat(scope, out):
        messages, first, total = scope["messages"]
        for k, message in enumerate(messages, first):
            inner = _Scope(scope)
            inner[name], inner["loop"] = message, (k + 1, k == 0, k == total - 1)
            body(inner, out)
    return repeat


def _block(nodes, escape, loop) -> Callable:
    steps = [_statement(n, escape, loop) for n in nodes]

    def run(scope, out):
        for step in steps:
            step(scope, out)
    return run


@dataclass(frozen=True)
class Template:
    """Source and the control strings that no formatted text may hold."""
    source: str
    controls: tuple[str, ...]


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    if any(len(c) < 2 or "\\" in c or c[0] in c[1:] for c in controls):
        raise TemplateError("a control string has two or more characters, no backslash, and its first one once")
    marks = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls), re.S) \
        if controls else re.compile(r"\\")
    return lambda text: marks.sub(lambda m: m[0] + "\\", text)


_UNESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    """The text that was escaped: every backslash goes and keeps what follows it."""
    return _UNESCAPE.sub(lambda m: m[1], text)


def compiled(template: Template) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """``render(messages, first=0, total=None, head=True, tail=True) -> (text, spans)``.

    A conversation may be rendered in parts: ``first`` is the number of messages before this
    part, ``total`` that of all; what stands outside the loop comes with the first and last
    part only."""
    escape = escaper(template.controls)
    tree = fold(parse(template.source), escape)
    loops = [k for k, n in enumerate(tree) if n[0] == "for"]
    if len(loops) > 1:
        raise TemplateError("one loop over the messages")
    cut = loops[0] if loops else len(tree)
    before = _block(tree[:cut], escape, False)
    names = _block([n for n in tree[:cut] if n[0] == "set"], escape, False)
    inside = _block(tree[cut:cut + 1], escape, False)
    after = _block(tree[cut + 1:], escape, False)

    def render(messages, first: int = 0, total: int | None = None):
        total = first + len(messages) if total is None else total
        scope, out = _Scope(messages=(messages, first, total)), _Output()
        (names if first else before)(scope, out)
        inside(scope, out)
        if first + len(messages) == total:
            after(scope, out)
        return "".join(out.parts), out.spans
    return render


TURNS = Template(
    "{% for m in messages %}<turn {{ m.role | escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}",
    ("<turn ", "</turn>", ">\n"))


def parse_turns(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, bool]]:
    """(role, text, learnt) of every turn of a string formatted by :data:`TURNS`."""
    at, learnt = 0, {tuple(s) for s in spans}
    while at < len(text):
        head = text.index(">\n", at)
        end = text.index("</turn>", head + 2)
        if not text.startswith("<turn ", at) or not text.startswith("</turn>\n", end):
            raise ValueError("not a formatted conversation")
        yield (unescape(text[at + 6:head]), unescape(text[head + 2:end]), (head + 2, end) in learnt)
        at = end + 8


# ------------------------------------------------------------------------------- Spark

def format_conversations(rows: DataFrame, template: Template = TURNS, *, max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id, part (from 0), n_parts, n_turns (of the part), formatted, spans (array of start,
    end in code points of this part, the text to learn)."""
    compiled(template)  # a wrong template fails here, not in a task
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > max_turns)
    long = stored(long.select(F.struct("conv_id").alias("conv"), "total"))
    place = ["part", "first", "total"]
    if long.isEmpty():
        keyed = turns.select("*", *[F.lit(0).cast("bigint").alias(c) for c in place])
    else:
        # a struct key joins the null conversation too
        keyed = turns.withColumn("conv", F.struct("conv_id"))
        short = keyed.join(long, "conv", "left_anti").drop("conv") \
                     .select("*", *[F.lit(0).cast("bigint").alias(c) for c in place])
        tied = keyed.join(long, "conv").drop("conv").withColumn("tie", F.monotonically_increasing_id())
        order = [(c, True) for c in ("conv_id", "turn", "role", "text", "tie")]
        numbered = ranked(tied, order, rank_col="rank")
        starts = numbered.groupBy(F.struct("conv_id").alias("conv")).agg(F.min("rank").alias("start"))
        numbered = numbered.withColumn("conv", F.struct("conv_id")).join(starts, "conv") \
                           .withColumn("nth", F.col("rank") - F.col("start"))
        part = F.expr(f"nth div {max_turns}")
        keyed = short.unionByName(numbered.select("conv_id", "turn", "role", "text", part.alias("part"),
                                                  (part * max_turns).alias("first"), "total"))
    keyed = keyed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")

    def work(batches):
        render = compiled(template)
        held, key = [], None

        def finish():
            conv, part, first, total = key
            text, spans = render(held, first, total or None)
            n_parts = -(-total // max_turns) if total else 1
            return conv, part, n_parts, len(held), text, [{"start": a, "end": z} for a, z in spans]

        def batch_of(out):
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["conv_id", "part", "n_parts", "n_turns", "formatted", "spans"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        out, size = [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "part", "first", "total", "turn", "role", "text")]
            for conv, part, first, total, turn, role, text in zip(*cols):
                if key is not None and (conv, part) != key[:2]:
                    out.append(finish())
                    size += len(out[-1][4])
                    held = []
                    if size > 1 << 22 or len(out) >= 4096:
                        yield batch_of(out)
                        out, size = [], 0
                key = (conv, part, first, total)
                held.append(Message(role, text, turn))
        if held:
            out.append(finish())
        if out:
            yield batch_of(out)

    return keyed.mapInArrow(work, "conv_id bigint, part bigint, n_parts bigint, n_turns bigint, formatted string, "
                                  "spans array<struct<start: bigint, end: bigint>>")


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of conversations formatted by :data:`TURNS`, parsed out of the formatted strings."""

    def work(batches):
        key, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done():
            n, turns, chars, loss, size = state
            return key[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                if key != (conv,):
                    if key is not None:
                        out.append(done())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, learnt in parse_turns(text, [(s["start"], s["end"]) for s in spans]):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescape(text[s["start"]:s["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(done(), types)], names)

    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    single = parts.where("n_parts = 1").mapInArrow(work, schema)
    # the parts of one conversation one after another
    several = parts.where("n_parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part") \
                   .mapInArrow(work, schema)
    return single.unionByName(several)


# fixed values: the conversation that the registered query adds
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return read_back(stored(format_conversations(table.unionByName(extra))))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM (VALUES (0), (1)) v(n)
), e AS (
  SELECT *, length(role || text)
    + length(role || text) - length(replace(role || text, '\', ''))
    + (length(role) - length(replace(role, '<turn ', ''))) // 6 + (length(text) - length(replace(text, '<turn ', ''))) // 6
    + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + (length(role) - length(replace(role, '>' || chr(10), ''))) // 2
    + (length(text) - length(replace(text, '>' || chr(10), ''))) // 2 + 16 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
