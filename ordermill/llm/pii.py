"""Personal data in texts: regular expressions propose spans, checksums confirm them and
context words adjust their score (DataFrame functions only).

Base kinds: ``email``, ``ip`` (four parts of at most 255), ``card`` (16 to 19 digits that
pass Luhn) and ``phone`` (``+`` and 8 to 15 digits).  The method adds ``iban`` (mod-97) and
``ssn`` (three-two-four digits, kept only where a context word stands near).  Matches are
leftmost and do not overlap within a kind; offsets count code points, the end is exclusive.
Every span has a score: the kind's own confidence plus a bonus for a context word within
``CONTEXT`` characters before it.  Base spans always stay, the score only ranks them.

The patterns accept exactly the language stated beside them, written so that no text makes
them slow: runs are possessive, and a match may start only at the start of its run or
where the previous match ended, so every character is scanned a bounded number of times.

Defined results: a null text counts as empty; empty texts, tables and texts without
matches give counts 0 and empty span lists; repeated rows give repeated rows; extra columns
pass through ``find_spans`` and ``redact`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read_table

# fixed values: the contract's patterns, in run-safe spelling
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"
        r"(?![A-Za-z0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT = 40
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
WORDS = {
    "email": r"(?i)e-?mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|master|credit|payment",
    "phone": r"(?i)phone|tel|call|fax|mobile",
    "iban": r"(?i)iban|account|bank|konto",
    "ssn": r"(?i)ssn|social security",
}
BONUS, LIMIT = 0.3, 0.5
# a cheap necessary condition per kind, tested before the pattern runs
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces removed) passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    def step(acc, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.split(m, r"\.")
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(parts, lambda p: (F.length(small(p)) <= 3) & (small(p).cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start int, end int, found string, before string>> of the pattern's matches.

    Spark returns the matches without places.  Splitting the text by the same pattern gives
    the pieces between them, and running lengths give the code point offsets."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    # the piece after the last match pairs with null and drops out
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, p):
        lo = acc["at"] + F.length(p["g"])
        hi = lo + F.length(p["m"])
        one = F.struct(lo.alias("start"), hi.alias("end"), p["m"].alias("found"),
                       F.substring(p["g"], -CONTEXT, CONTEXT).alias("before"))
        return F.struct(F.coalesce(hi, acc["at"]).alias("at"),
                        F.when(p["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    out = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    need = NEEDS.get(kind)
    guard = F.contains(text, F.lit(need)) if need else text.rlike(pattern)
    return F.when(guard, out).otherwise(empty)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(text: Column) -> Column:
    """All spans of a text as array<struct<kind, start, end, score>>, by kind as in ``KINDS``
    and then by start."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_confirmed(text, kind) for kind in KINDS]).cast(SPAN)


def _confirmed(text: Column, kind: str) -> Column:
    """The confirmed, scored spans of one kind."""
    good = F.filter(_matches(text, kind), lambda m: _valid(kind, m["found"]))
    part = F.transform(good, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(m["before"].rlike(WORDS[kind]), BONUS).otherwise(0.0)).alias("score")))
    return part if kind in BASE else F.filter(part, lambda s: s["score"] >= LIMIT)


def find_spans(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with a column ``out_col`` of :func:`spans`."""
    return docs.withColumn(out_col, spans(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; texts
    without a span, null ones included, stay as they are."""
    col = free_name(docs, "_spans")
    text = F.col(text_col)
    found = F.array_sort(F.transform(F.col(col), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        lo = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substring(text, acc["at"] + 1, lo - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        inside = s["end"] <= acc["at"]
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    def done(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    new = F.when(F.size(col) > 0, F.aggregate(found, zero, step, done)).otherwise(text)
    return find_spans(docs, text_col, col).withColumn(text_col, new).select(*docs.columns)


def _listed(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                               s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))
