"""Periodic runs of words, found on a Re-Pair grammar of every text.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are identical)
that no neighbouring word extends; those of at least ``max(least, 3 * q)`` words are
reported, and a text is *collapsed* by keeping only the first period of each.

1. **Re-Pair** (:func:`grammar`).  The word ids of a text are paired recursively: in every
   round a pair of neighbouring symbols that is more frequent than both pairs it overlaps
   is replaced by a new nonterminal wherever it stands, until no pair occurs twice; ties
   go by a hash, so that a round shortens every repetition and few rounds are needed.  The
   places at which a nonterminal was put are its derivation positions.  What is left is
   paired up to one symbol as a balanced tree.
2. **Runs across a boundary** (:func:`crossing`), once per nonterminal ``X -> Y Z``, on its
   first position only.  A run of ``m`` words and period ``q`` across the boundary has at
   least ``w = max(least / 2, 1.5 * q)`` words on one side, so for each ``q`` one comparison
   of fingerprints next to the boundary decides; the few survivors are extended both ways
   by binary search on fingerprints and then verified word by word.
3. **Translation and merging** (:func:`runs_of`).  The intervals go to all derivation positions;
   intervals of one period that share a period or more are one run.  The smallest node
   that holds a whole run finds all of it, so the merged intervals are maximal.

All steps work on arrays over a slice of texts cut by words, not by rows (``SLICE``); a
longer text is a slice of its own, so memory is in proportion to the longest text.

Defined results: null and empty texts have no words and no runs; a null id is kept (and in
the registered query not rewritten); repeated rows are reported each; texts of any length
are read whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table

LEAST = 24         # words of the shortest run
SLICE = 400_000    # words handled at once
PAIRS = 2_000_000  # (node, period) candidates compared at once

_PRIMES = (2147483647, 2147483629)  # fingerprints are taken modulo both
_BASES = (911382323, 972663749)
_powers = {p: np.ones(1, np.int64) for p in _PRIMES}


def _power(p: int, base: int, n: int) -> np.ndarray:
    have = _powers[p]
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), p) % p])
    if len(have) <= 2 * SLICE:  # a longer text's powers are not kept
        _powers[p] = have
    return have[:n]


class Words:
    """Word ids of a slice of texts (ids of different texts differ) with fingerprints."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.ids, self.doc = ids, doc
        mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
        self.sums, self.powers = [], []
        for p, base in zip(_PRIMES, _BASES):
            powers = _power(p, base, len(ids) + 1)
            value = (mixed % np.uint64(p)).astype(np.int64)
            self.sums.append(np.concatenate([[0], np.cumsum(value * powers[:-1] % p)]))
            self.powers.append(powers)

    def equal(self, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Do the ``n`` words from ``x`` have the fingerprint of those ``q`` further on?"""
        out = np.ones(len(x), bool)
        for p, s, powers in zip(_PRIMES, self.sums, self.powers):
            a, b = (s[x + n] - s[x]) % p, (s[x + q + n] - s[x + q]) % p
            out &= a * powers[q] % p == b
        return out

    def forward(self, x, q, most):
        """The longest ``n <= most`` with words [x, x + n) equal to those ``q`` further on."""
        return self._longest(most, lambda k, n: self.equal(x[k], q[k], n))

    def backward(self, x, q, most):
        """The same for the words that end before ``x`` and before ``x + q``."""
        return self._longest(most, lambda k, n: self.equal(x[k] - n, q[k], n))

    @staticmethod
    def _longest(most, same):
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64).copy()
        open_ = np.flatnonzero(low < high)
        while open_.size:
            mid = (low[open_] + high[open_] + 1) >> 1
            ok = same(open_, mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def grammar(ids: np.ndarray, doc: np.ndarray):
    """Re-Pair of every text of a slice at once.

    Returns (rules, uses, rest): ``rules`` is (length of the left part, length) per
    nonterminal, ``uses`` its (nonterminal, position) list, ``rest`` the (position, text)
    of the symbols that are left, in text order."""
    sym, at, own = ids.astype(np.int64), np.arange(len(ids), dtype=np.int64), doc
    size = np.ones(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    left_size, uses, done, first = [], [], [], len(size)
    while len(sym) > 1:
        count = np.bincount(sym, minlength=len(size))
        a, b = sym[:-1], sym[1:]
        may = (own[:-1] == own[1:]) & (count[a] > 1) & (count[b] > 1)
        # of a stretch of one symbol, only every other pair can be replaced
        same = may & (a == b)
        if same.any():
            i = np.arange(len(same))
            last = np.maximum.accumulate(np.where(same, -1, i))
            may &= ~(same & ((i - last) % 2 == 0))
        where = np.flatnonzero(may)
        pair, which, times = np.unique(a[where] * len(size) + b[where], return_inverse=True, return_counts=True)
        rank = np.zeros(len(sym) + 1, np.int64)  # of the pair that starts at i, at place i + 1
        rank[where + 1] = np.where(times[which] > 1, (times[which] << 32)
                                   + (mix64(pair.astype(np.uint64))[which] >> np.uint64(33)).astype(np.int64) + 1, 0)
        mine = rank[where + 1]
        take = (mine > 0) & (mine > rank[where]) & (mine >= rank[np.minimum(where + 2, len(sym))])
        often = np.bincount(which[take], minlength=len(pair))
        take &= often[which] > 1
        alive = np.zeros(int(own[-1]) + 1, bool)
        alive[own[where[take]]] = True
        quiet = ~alive[own]
        if quiet.any():
            done.append((at[quiet], own[quiet]))
        if not take.any():
            break
        new = np.cumsum(often > 1) - 1 + len(size)
        spot = where[take]
        uses.append((new[which[take]], at[spot]))
        made = np.flatnonzero(often > 1)
        lefts, rights = pair[made] // len(size), pair[made] % len(size)
        left_size.append(size[lefts])
        sym = sym.copy()
        sym[spot] = new[which[take]]
        size = np.concatenate([size, size[lefts] + size[rights]])
        stay = ~quiet
        stay[spot + 1] = False
        sym, at, own = sym[stay], at[stay], own[stay]
    else:
        done.append((at, own))
    rest = np.concatenate([d[0] for d in done]) if done else at
    rest_doc = np.concatenate([d[1] for d in done]) if done else own
    order = np.argsort(rest)
    rules = (np.concatenate(left_size) if left_size else np.zeros(0, np.int64), size[first:])
    name = np.concatenate([u[0] for u in uses]) - first if uses else np.zeros(0, np.int64)
    place = np.concatenate([u[1] for u in uses]) if uses else np.zeros(0, np.int64)
    return rules, (name, place), (rest[order], rest_doc[order])


def tree(rest: np.ndarray, doc: np.ndarray, ends: np.ndarray):
    """Levels (start, boundary, end) of a balanced tree over the symbols left of each text."""
    start, own = rest, doc
    while len(start) > 1:
        first = np.flatnonzero(np.diff(own, prepend=-1))
        nth = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        head = nth % 2 == 0
        end = np.append(start[1:], 0)
        last = np.append(own[1:] != own[:-1], True)
        end[last] = ends[own[last]]
        pair = np.flatnonzero(head & ~last)
        if not pair.size:
            return
        yield start[pair], start[pair + 1], end[pair + 1]
        start, own = start[head], own[head]


def crossing(words: Words, s, b, e, least: int):
    """(start, end, period, node) of the runs of [s, e) that cross ``b``, per node; maximal
    inside the node, with their smallest period."""
    big = np.flatnonzero(e - s >= least)
    s, b, e = s[big], b[big], e[big]
    third = (e - s) // 3
    half = least // 2
    found = []
    for side, room in ((-1, b - s), (1, e - b)):
        top = np.where(room >= half, np.minimum(third, 2 * room // 3), 0)
        total = np.concatenate([[0], np.cumsum(top)])
        for lo in range(0, int(total[-1]), PAIRS):
            flat = np.arange(lo, min(lo + PAIRS, int(total[-1])))
            node = np.searchsorted(total, flat, side="right") - 1
            q = flat - total[node] + 1
            mid = b[node]
            near, far = (mid - 1, mid - 1 - q) if side < 0 else (mid, mid + q)
            keep = words.ids[near] == words.ids[far]
            node, q, mid = node[keep], q[keep], mid[keep]
            wide = np.maximum(half, q + (q + 1) // 2)
            keep = words.equal(mid - wide if side < 0 else mid, q, wide - q)
            found.append((node[keep], q[keep], np.full(int(keep.sum()), side)))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    node, q, side = (np.concatenate(c) for c in zip(*found))
    mid = b[node]
    x = np.where(side < 0, mid - q, mid)  # the words from x on are compared with those q further on
    ahead = words.forward(x, q, e[node] - x - q)
    back = words.backward(x, q, x - s[node])
    i, j = x - back, x + q + ahead
    keep = (i < mid) & (j > mid) & (j - i >= np.maximum(least, 3 * q))
    rows = np.stack([node, i, j, q])[:, keep]
    # a multiple of a period spans the same words: the smallest one counts
    rows = rows[:, np.lexsort(rows[[3, 2, 1, 0]])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    node, i, j, q = rows[:, fresh]
    return i, j, q, big[node]


def _false(words: Words, i, j, q) -> np.ndarray:
    """Which intervals do not have their period, word by word?"""
    wrong = np.zeros(len(i), bool)
    total = np.concatenate([[0], np.cumsum(j - i - q)])
    for lo in range(0, int(total[-1]), PAIRS):
        flat = np.arange(lo, min(lo + PAIRS, int(total[-1])))
        k = np.searchsorted(total, flat, side="right") - 1
        x = i[k] + flat - total[k]
        wrong[k[words.ids[x] != words.ids[x + q[k]]]] = True
    return wrong


def _direct(ids: np.ndarray, least: int):
    """Runs by comparing the words with themselves at every distance: the way out where a
    fingerprint was found to be wrong."""
    seen, out = set(), []
    for q in range(1, len(ids) // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]])))
        for i, j in zip(edge[0::2].tolist(), (edge[1::2] + q).tolist()):
            if j - i >= max(least, 3 * q) and (i, j) not in seen:
                seen.add((i, j))
                out.append((i, j, q))
    return out


def runs_of(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of a slice, by start and period.  ``doc`` is the
    text of each word, ``ends`` the place after each text's last word."""
    if len(ids) < least:
        return np.zeros((0, 3), np.int64)
    words = Words(ids, doc)
    (left, size), (name, place), (rest, rest_doc) = grammar(ids, doc)
    out = []
    if len(size):
        order = np.argsort(name, kind="stable")
        name, place = name[order], place[order]
        lead = np.searchsorted(name, np.arange(len(size)))
        home = place[lead]
        i, j, q, rule = crossing(words, home, home + left, home + size, least)
        bad = _false(words, i, j, q)
        uses = np.diff(np.append(lead, len(name)))[rule]  # every interval goes to each of its rule's positions
        k = np.repeat(np.arange(len(i)), uses)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(uses) - uses, uses)
        shift = place[lead[rule[k]] + nth] - home[rule[k]]
        out.append(np.stack([i[k] + shift, j[k] + shift, q[k], bad[k]]))
    for s, b, e in tree(rest, rest_doc, ends):
        i, j, q, _ = crossing(words, s, b, e, least)
        out.append(np.stack([i, j, q, _false(words, i, j, q)]))
    if not out:
        return np.zeros((0, 3), np.int64)
    i, j, q, bad = np.concatenate(out, axis=1)
    doubt = np.unique(doc[i[bad > 0]])
    if doubt.size:
        keep = ~np.isin(doc[i], doubt)
        i, j, q = i[keep], j[keep], q[keep]
    order = np.lexsort((i, q))
    i, j, q = i[order], j[order], q[order]
    if len(i):
        # the furthest end so far among the intervals of the same period
        wide = int(j.max()) + 1
        group = np.cumsum(np.diff(q, prepend=q[0]) != 0)
        reach = np.maximum.accumulate(group * wide + j) - group * wide
        fresh = np.ones(len(i), bool)
        fresh[1:] = (np.diff(q) != 0) | (i[1:] > reach[:-1] - q[1:])
        lead = np.flatnonzero(fresh)
        i, q, j = i[lead], q[lead], reach[np.append(lead[1:], len(reach)) - 1]
    rows = [np.stack([i, j, q], axis=1)]
    for d in doubt.tolist():
        lo, hi = np.searchsorted(doc, [d, d + 1])
        rows.append(np.array([(lo + a, lo + z, p) for a, z, p in _direct(ids[lo:hi], least)], np.int64).reshape(-1, 3))
    rows = np.concatenate(rows)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie outside every run's part after its first period?"""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _slices(batches, prepare):
    """Lists of (id, words) of about ``SLICE`` words."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            text = (text.as_buffer() or b"") if text.is_valid else b""
            words = bytes(text).split()  # bytes are cut at exactly the six ASCII blanks
            if prepare is not None:
                words = prepare(key, words)
            held.append((key, words))
            size += len(words)
            if size >= SLICE or len(held) >= 4096:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(rows):
    """Word ids, the text of every word, and the place after each text's last word."""
    ids, doc, ends, base = [], [], [], 0
    for d, (_, words) in enumerate(rows):
        number = defaultdict()
        number.default_factory = number.__len__
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) + base)
        base += len(number)
        doc.append(np.full(len(words), d, np.int64))
        ends.append(len(words))
    return np.concatenate(ids), np.concatenate(doc), np.cumsum(ends)


def find_runs(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
              prepare=None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period) and
    ``collapsed``, the kept words joined by one space, per row of ``docs``.

    ``prepare(id, words)`` may return another list of words (as UTF-8) to work on."""

    def work(batches):
        for rows in _slices(batches, prepare):
            ids, doc, ends = _numbered(rows)
            runs = runs_of(ids, doc, ends, least)
            cut = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
            out_runs, texts = [], []
            for d, (_, words) in enumerate(rows):
                mine = runs[cut[d]:cut[d + 1]] - np.array([ends[d] - len(words)] * 2 + [0])
                out_runs.append([{"start": i, "length": j - i, "period": q} for i, j, q in mine.tolist()])
                if len(mine):
                    words = [words[k] for k in np.flatnonzero(kept(len(words), mine)).tolist()]
                texts.append(b" ".join(words))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int64()),
                 pa.array(out_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")) \
               .mapInArrow(work, "doc_id bigint, n_words bigint, "
                                 "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(key, words: list[bytes]) -> list[bytes]:
    """The words of the registered query: every tenth document (by crc32 of its id) repeats
    a stretch of itself up to its end."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def summary(found: DataFrame) -> DataFrame:
    """The run with the greatest length / period (ties: first start, then period) and digests."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.select("*", best.alias("top"))
    return top.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_runs(read_table(spark, sf_dir, "documents"), prepare=planted))
