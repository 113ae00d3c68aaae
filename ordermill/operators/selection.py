"""Rows at given places of a global order, found by counting and not by sorting.

``NTILE`` borders, quartile edges and winsorising bounds need a handful of rows of a global
order, not a rank for every row.  :func:`select_ranks` finds them as a radix select does:

1. one pass gives, per group, the number of rows and the least and greatest key;
2. a pass counts rows per coarse bucket of the interval in which a wanted place lies, with at
   most ``BUCKETS`` buckets, summed before the shuffle; the bucket that holds the place becomes
   the next interval, from its own least to its own greatest key.  Intervals of all wanted places
   of all orders are narrowed by the same pass;
3. once one value is left, the search goes on with the next column of the order among the rows
   that have it; once an interval holds at most ``FETCH`` rows, these come to the driver and
   the place is read off.

A pass shuffles a few thousand counts whatever the size of the table, so there is no range
shuffle, no sort and no checkpoint, and a value that a third of all rows share is one count.
Each pass narrows the interval by the factor ``BUCKETS``; the number of passes grows with the
logarithm of the number of rows, and is three or four in practice.  Every pass reads the frame anew: hand in a
stored one if it is expensive.

What is found are column values, so a row's place relative to a border is a comparison
(:func:`after`) inside a projection: no join and no rank column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.functions.time import micros_between

Order = Sequence[tuple[str, bool]]  # (column, ascending)

BUCKETS = 2048  # counts per interval and pass
FETCH = 1024    # rows of an interval that are read instead of counted once more
CHUNK = 7       # bytes of a string compared as one integer
_EPOCH = datetime(1970, 1, 1)


@dataclass
class _Part:
    """One column of an order as integer keys, ascending whatever the column's direction."""
    keys: list[Column]
    decode: Callable[[list[int]], object]


def selectable(dtype: T.DataType) -> bool:
    """Whether values of this type have integer keys in their own order."""
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DecimalType,
                              T.DateType, T.TimestampNTZType, T.StringType))


def _parts(df: DataFrame, order: Order) -> list[_Part]:
    texts = [c for c, _ in order if isinstance(df.schema[c].dataType, T.StringType)]
    longest = {}
    if texts:
        row = df.agg(*[F.max(F.octet_length(F.col(c))).alias(f"m{i}") for i, c in enumerate(texts)]).first()
        longest = {c: row[i] or 0 for i, c in enumerate(texts)}
    out = []
    for name, ascending in order:
        value, fld = F.col(name), df.schema[name]
        if not selectable(fld.dataType):
            raise TypeError(f"{name}: no counting select over {fld.dataType.simpleString()}; use the range method")
        pairs, decode = _value_keys(value, fld.dataType, longest.get(name, 0))
        keys = [k if ascending else -k if wide else F.bitwise_not(k) for k, wide in pairs]
        flips = [_flip(ascending, wide) for _, wide in pairs]
        if fld.nullable:
            keys = [F.coalesce(k, F.lit(0)) for k in keys]
            # nulls come first in ascending order, last in descending order
            keys.insert(0, F.when(value.isNull(), 0 if ascending else 1).otherwise(1 if ascending else 0).cast("bigint"))

        def undo(found, decode=decode, flips=flips, nullable=fld.nullable, ascending=ascending):
            if nullable:
                if found[0] == (0 if ascending else 1):
                    return None
                found = found[1:]
            return decode([f(k) for f, k in zip(flips, found)])
        out.append(_Part(keys, undo))
    return out


def _flip(ascending: bool, wide: bool) -> Callable[[int], int]:
    if ascending:
        return lambda k: k
    return (lambda k: -k) if wide else (lambda k: ~k)


def _value_keys(value: Column, dtype: T.DataType, longest: int):
    """([(key, is it a decimal?)], decode) of a column in its ascending order."""
    if isinstance(dtype, T.BooleanType):
        return [(value.cast("int").cast("bigint"), False)], lambda k: bool(k[0])
    if isinstance(dtype, T.DateType):
        return [(F.unix_date(value).cast("bigint"), False)], lambda k: date(1970, 1, 1) + timedelta(days=k[0])
    if isinstance(dtype, T.TimestampNTZType):
        return [(micros_between(F.lit(_EPOCH).cast("timestamp_ntz"), value), False)], \
            lambda k: _EPOCH + timedelta(microseconds=k[0])
    if isinstance(dtype, T.DecimalType):
        scale = dtype.scale
        if dtype.precision <= 18:
            scaled = (value.cast(f"decimal(38,{scale})") * F.lit(10 ** scale).cast("decimal(19,0)")) if scale else value
            return [(scaled.cast("bigint"), False)], lambda k: Decimal(k[0]).scaleb(-scale)
        # whole part and fraction apart, as the unscaled value may not fit
        whole = F.floor(value).cast("decimal(38,0)")
        rest = ((value - whole).cast(f"decimal(38,{scale})") * F.lit(10 ** min(scale, 18)).cast("decimal(19,0)")).cast("bigint")
        if scale > 18:
            raise TypeError("decimals of more than 18 places have no counting select")
        return [(whole, True), (rest, False)], lambda k: Decimal(k[0]) + Decimal(k[1]).scaleb(-scale)
    if isinstance(dtype, T.StringType):
        raw = value.cast("binary")
        keys = [(F.conv(F.rpad(F.hex(F.substring(raw, 1 + at, CHUNK)), 2 * CHUNK, "0"), 16, 10).cast("bigint"), False)
                for at in range(0, longest, CHUNK)]

        def text(k):
            return b"".join(x.to_bytes(CHUNK, "big") for x in k[:-1])[:k[-1]].decode()
        return [*keys, (F.octet_length(value).cast("bigint"), False)], text
    return [(value.cast("bigint"), False)], lambda k: k[0]


@dataclass
class _Search:
    group: tuple
    order: int
    rank: int                     # place among the rows that match what is found so far
    keys: list[str]
    span: dict                    # key -> (least, greatest) in the group
    found: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    rows: int | None = None       # rows in the interval, if counted

    def start(self):
        self.low, self.high = self.span[self.keys[len(self.found)]]
        return self.settle()

    def settle(self):
        """One value left: it is found, and the next key is searched."""
        while len(self.found) < len(self.keys) and self.low == self.high:
            self.found.append(self.low)
            if len(self.found) < len(self.keys):
                self.low, self.high = self.span[self.keys[len(self.found)]]
        return self

    @property
    def done(self) -> bool:
        return len(self.found) == len(self.keys)

    def cell(self):
        return self.group, tuple(self.keys), tuple(self.found), self.low, self.high


def _literal(value: int, dtype: str) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)") if dtype != "bigint" else F.lit(value).cast("bigint")


def select_ranks(df: DataFrame, orders: Sequence[Order], ranks: Sequence[Callable[[int], Sequence[int]]], *,
                 by: Sequence[str] = (), weight: str | None = None, known: bool = False,
                 ) -> dict[tuple, list[tuple[int, list[tuple]]]]:
    """``{group: [(rows, [values of the order's columns at each place]) per order]}``.

    ``ranks[i](n)`` names the places (from 0) wanted in order ``i`` of a group with ``n`` rows.  An order may
    leave ties: rows that agree in all its columns are interchangeable.  ``weight`` is a column of
    multiplicities.  With ``known`` the rows counted in an order are those whose first column is not
    null.  The groups of ``by`` are few: their state is on the driver."""
    parts = [_parts(df, order) for order in orders]
    names, columns = [], []
    for i, order in enumerate(orders):
        names.append([f"_k{i}_{j}" for j in range(sum(len(p.keys) for p in parts[i]))])
        columns += [k.alias(n) for n, k in zip(names[i], (k for p in parts[i] for k in p.keys))]
    groups = [f"_b{i}" for i in range(len(by))]
    frame = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], *columns,
                      (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    keys = [k for ks in names for k in ks]
    spans = frame.groupBy(*groups) if groups else frame
    flagged = [known and df.schema[order[0][0]].nullable for order in orders]  # the first key tells nulls
    stats = [F.sum(F.when(F.col(names[i][0]) == (0 if order[0][1] else 1), F.col("_w"))).alias(f"_z{i}")
             for i, order in enumerate(orders) if flagged[i]]
    out, open_ = {}, []
    for row in spans.agg(F.sum("_w").alias("_n"), *stats,
                         *[f(k).alias(f"{f.__name__}{k}") for k in keys for f in (F.min, F.max)]).collect():
        group, n = tuple(row[g] for g in groups), row["_n"] or 0
        span = {k: (int(row[f"min{k}"]), int(row[f"max{k}"])) for k in keys} if n else {}
        found = []
        for i, (order, wanted) in enumerate(zip(orders, ranks)):
            nulls = (row[f"_z{i}"] or 0) if flagged[i] else 0
            skip = nulls if order[0][1] else 0
            mine = [_Search(group, i, r + skip, names[i], span).start() for r in wanted(n - nulls)] if n > nulls else []
            found.append((n - nulls, mine))
            open_ += [s for s in mine if not s.done]
        out[group] = found
    while open_:
        cells = {}
        for s in open_:
            cells.setdefault(s.cell(), []).append(s)
        counted = [c for c, who in cells.items() if who[0].rows is None or who[0].rows > FETCH]
        if counted:
            _narrow(frame, groups, kinds, counted, cells)
        else:
            _read_off(frame, groups, kinds, list(cells), cells)
        open_ = [s for s in open_ if not s.done]
    return {group: [(n, [_decoded(s, parts[i]) for s in mine]) for i, (n, mine) in enumerate(found)]
            for group, found in out.items()}


def _decoded(search: _Search, parts: list[_Part]) -> tuple:
    out, at = [], 0
    for p in parts:
        out.append(p.decode(search.found[at:at + len(p.keys)]))
        at += len(p.keys)
    return tuple(out)


def _inside(groups, kinds, cell) -> Column:
    """Whether a row lies in the cell's interval."""
    group, keys, found, low, high = cell
    tests = [F.col(g).eqNullSafe(F.lit(v).cast(kinds[g])) for g, v in zip(groups, group)]
    tests += [F.col(k) == _literal(v, kinds[k]) for k, v in zip(keys, found)]
    key = keys[len(found)]
    tests.append(F.col(key).between(_literal(low, kinds[key]), _literal(high, kinds[key])))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _narrow(frame, groups, kinds, counted, cells) -> None:
    """One counting pass over the frame for all ``counted`` intervals."""
    wide = any(kinds[c[1][len(c[2])]] != "bigint" for c in counted)
    shared = "decimal(38,0)" if wide else "bigint"
    marks = []
    for number, cell in enumerate(counted):
        _, keys, found, low, high = cell
        key = keys[len(found)]
        width = (high - low) // BUCKETS + 1
        # division drops the remainder towards zero, which keeps the order
        bucket = F.call_function("div", F.col(key), _literal(width, kinds[key]))
        marks.append(F.when(_inside(groups, kinds, cell), F.struct(
            F.lit(number).alias("cell"), bucket.cast(shared).alias("bucket"), F.col(key).cast(shared).alias("key"))))
    hits = frame.select("_w", F.explode(F.array_compact(F.array(*marks))).alias("m"))
    rows = hits.groupBy("m.cell", "m.bucket").agg(
        F.sum("_w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("m.key").alias("low"), F.max("m.key").alias("high")).collect()
    tables = {}
    for r in sorted(rows, key=lambda r: (r["cell"], r["bucket"])):
        tables.setdefault(r["cell"], []).append((r["n"], r["rows"], int(r["low"]), int(r["high"])))
    for number, cell in enumerate(counted):
        for s in cells[cell]:
            for n, many, low, high in tables[number]:
                if s.rank < n:
                    s.low, s.high, s.rows = low, high, many
                    break
                s.rank -= n
            s.settle()


def _read_off(frame, groups, kinds, small, cells) -> None:
    """Intervals of at most ``FETCH`` rows each, read and sorted here."""
    marks = [F.when(_inside(groups, kinds, cell), F.struct(
        F.lit(number).alias("cell"),
        F.array(*[F.col(k).cast("decimal(38,0)") for k in cell[1][len(cell[2]):]]).alias("keys")))
        for number, cell in enumerate(small)]
    hits = frame.select("_w", F.explode(F.array_compact(F.array(*marks))).alias("m"))
    tables = {}
    for r in hits.groupBy("m.cell", "m.keys").agg(F.sum("_w").alias("n")).collect():
        tables.setdefault(r["cell"], []).append((tuple(int(k) for k in r["keys"]), r["n"]))
    for number, cell in enumerate(small):
        table = sorted(tables[number])
        for s in cells[cell]:
            for keys, n in table:
                if s.rank < n:
                    s.found += keys
                    break
                s.rank -= n


def after(df: DataFrame, order: Order, values: Sequence) -> Column:
    """Whether a row comes after the row with these values of the order's columns."""
    out = F.lit(False)
    for (name, ascending), value in reversed(list(zip(order, values))):
        col, border = F.col(name), F.lit(value).cast(df.schema[name].dataType)
        if value is None:
            later = col.isNotNull() if ascending else F.lit(False)
            out = later | (col.isNull() & out)
        elif ascending:
            out = F.coalesce((col > border) | ((col == border) & out), F.lit(False))
        else:
            out = F.coalesce((col < border) | ((col == border) & out), F.lit(True))  # nulls are last
    return out


def steps(df: DataFrame, order: Order, borders: Sequence[Sequence]) -> Column:
    """1 plus the number of borders that a row comes after."""
    out = F.lit(1).cast("bigint")
    for b in borders:
        out = out + after(df, order, b).cast("bigint")
    return out


def tile_borders(buckets: int) -> Callable[[int], list[int]]:
    """Places of the last rows of all but the last tile of ``NTILE(buckets)`` over ``n`` rows."""
    def of(n: int) -> list[int]:
        small, more = divmod(n, buckets)
        ends = [t * small + min(t, more) for t in range(1, buckets)]
        return [e - 1 for e in ends if 0 < e < n]
    return of
