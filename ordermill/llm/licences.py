"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Texts are cut into lines, and into paragraphs at lines without words.  Both are read in
windows of ``WINDOW`` words that overlap by half, paragraphs by those that cross a line end
and, for short notices amid other words, once more by windows of half the width.
A softmax regression over hashed word uni- and bigrams gives each window a probability per
licence family and for "none".  It is trained here, on the notices below in many wordings, one or
two to a text, and on a bounded sample of the corpus's own lines as negatives.  A part of this set is
held out and calibrates it: the temperature; ``named``, the probability that all but ``MISSED`` of the families
of held-out texts reach in them; and ``doubt``, the probability of not being "none" that no more than
``FALSE`` of the held-out negatives reach.

*The regression names the families*: all that reach ``named`` in a window whose probability of not being "none"
is at least ``MIN_PROBABILITY``.  *The templates confirm them*: the window is compared with the notices of the named
families, together with ``WINDOW`` words of its paragraph on both sides, so that a notice cut
by its ends is seen whole.  Each notice that touches the window, with at least
``MIN_CONTAINED`` of its word bigrams within ``WINDOW`` words, is reported, once however many
windows show it.  The best contained notice of all takes its words; others need words of their
own, so "CC BY-NC" does not count as "CC BY" too (an unnamed family is not reported, but keeps its words).  *Unknown* is a full window that is no "none" by ``doubt``
and in which no named family is confirmed; across line ends only if no other window there is reported.

The sample is the only part of the corpus that fitting sees, at most ``SAMPLE`` different lines
of at most ``SAMPLE_CHARS`` characters; scanning covers every word of every text.

Defined results: null and empty texts have no licence; repeated rows give repeated rows;
an empty table gives no rows (the model is then trained without corpus negatives); extra
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_hash
from .words import combined, starts_of, word_hashes

WINDOW, BITS = 16, 14
SAMPLE, SAMPLE_CHARS = 3000, 400
STEPS = 100
MIN_PROBABILITY, MIN_CONTAINED = 0.5, 0.6
MISSED, FALSE = 0.005, 0.002  # shares of held-out families below ``named`` and of negatives above ``doubt``

# fixed values: short notices by which works name their licence
TEMPLATES = {
    "agpl-3.0": ["licensed under the GNU Affero General Public License version 3", "released under the AGPL v3"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2.0": ["licensed under the Apache License Version 2.0", "released under the Apache License 2.0",
                   "you may not use this file except in compliance with the License"],
    "bsd": ["released under the BSD License", "licensed under the BSD 3-Clause License", "licensed under the BSD 2-Clause License",
            "redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0", "released under CC0 1.0 Universal"],
    "gpl-2.0": ["licensed under the GNU General Public License version 2", "released under the GPL v2"],
    "gpl-3.0": ["licensed under the GNU General Public License version 3", "released under the GPL v3"],
    "lgpl": ["licensed under the GNU Lesser General Public License version 3", "licensed under the GNU Lesser General Public License version 2.1"],
    "mit": ["released under the MIT License", "licensed under the MIT License",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License Version 2.0", "licensed under the Mozilla Public License Version 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
FAMILIES = sorted(TEMPLATES)
_LEADS = ["", "this work is ", "this software is ", "this file is ", "copyright ", "the content of this page is ", "text "]
_TAILS = ["", " see the licence file", " for details see below", " by the authors", " or later"]

# letters lower-cased, digits kept, other ASCII blank, line ends kept: other bytes are letters
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _features(text: str) -> np.ndarray:
    """Slots of a text's word uni- and bigrams."""
    h = word_hashes([fold(text)])[0]
    return np.concatenate([_slots(h), _slots(combined(h, 2))])


class Model:
    """Weights (slot x class, "none" last), bias, calibrated figures, and the templates' bigrams."""

    def __init__(self, weights, bias, temperature, named=0.0, doubt=MIN_PROBABILITY):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.named, self.doubt = named, doubt
        self.templates = {f: [np.unique(combined(word_hashes([fold(t)])[0], 2)) for t in ts] for f, ts in TEMPLATES.items()}
        each = [(FAMILIES.index(f), t) for f, ts in self.templates.items() for t in ts]
        self.family = [k for k, _ in each]
        self.vocabulary = np.unique(np.concatenate([t for _, t in each]))
        self.sets = [frozenset(np.searchsorted(self.vocabulary, t).tolist()) for _, t in each]

    def logits(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (sums / np.sqrt(np.maximum(words, 1))[:, None] + self.bias) / self.temperature

    def contained(self, family: str, bigrams: np.ndarray) -> float:
        return max(np.isin(t, bigrams).mean() for t in self.templates[family])

    def known_bigrams(self, pairs: np.ndarray) -> np.ndarray:
        """Each bigram's number among those of the templates, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, pairs), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == pairs, at, -1)

    def best_share(self, ids: np.ndarray) -> float:
        have = set(ids[ids >= 0].tolist())
        return max(len(own & have) / len(own) for own in self.sets)

    def notices(self, ids: np.ndarray, p: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(family, first word, end, containment) of the notices of the families that ``p`` names in a
        run of bigrams, the best contained first (then the longer, then the more probable).  A notice's bigrams speak
        for it alone: its near relatives must be contained in what is left."""
        left, out = {j: x for j, x in enumerate(ids.tolist()) if x >= 0}, []
        while left:
            have, best = set(left.values()), None
            most = [(len(own & have) / len(own), t) for t, own in enumerate(self.sets)]
            for bound, t in sorted(most, reverse=True):
                if bound < (MIN_CONTAINED if best is None else best[0][0]):
                    break
                own = [j for j, x in left.items() if x in self.sets[t]]
                for k, s in enumerate(own):  # the fullest, then the shortest run of at most WINDOW words
                    marks = {}
                    for j in own[k:]:
                        if j > s + WINDOW - 2:
                            break
                        marks.setdefault(left[j], j)
                    where = list(marks.values())
                    share = len(where) / len(self.sets[t])
                    rank = (share, len(where), p[self.family[t]], s - where[-1], -s)
                    if share >= MIN_CONTAINED and (best is None or rank > best[0]):
                        best = rank, t, where
            if best is None:
                break
            rank, t, where = best
            for j in where:
                del left[j]
            if p[self.family[t]] >= self.named:  # else it only keeps its words from its relatives
                out.append((FAMILIES[self.family[t]], where[0], where[-1] + 2, rank[0]))
        return out


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], seed: int = 11) -> Model:
    """Fit on wordings of the templates and on paragraphs that hold none of them."""
    rng = np.random.default_rng(seed)
    none = len(FAMILIES)
    known = Model(None, None, 1.0)
    clean = []
    for text in negatives:
        pairs = combined(word_hashes([fold(text)])[0], 2)
        if max(known.contained(f, pairs) for f in FAMILIES) < 0.3:
            clean.append(text)
    texts, labels = [], []
    filler = [w for t in clean[:500] for w in t.split()[:20]] or ["the", "text"]
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            for lead in _LEADS:
                for tail in _TAILS:
                    words = (lead + t + tail).split()
                    if rng.random() < 0.3 and len(words) > 6:
                        words.pop(int(rng.integers(len(words))))
                    extra = list(rng.choice(filler, int(rng.integers(0, max(1, WINDOW - len(words))))))
                    texts.append(" ".join([*extra, *words] if rng.random() < 0.5 else [*words, *extra]))
                    labels.append(k)
    second = [-1] * len(texts)
    notices = [(k, t) for k, family in enumerate(FAMILIES) for t in TEMPLATES[family]]
    for k, t in notices * 12:  # two licences in one text share its probability
        j, u = notices[int(rng.integers(len(notices)))]
        if j != k:
            texts.append(f"{t} {rng.choice(['or', 'and', '', '/'])} {u}")
            labels.append(k)
            second.append(j)
    for text in clean:
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 4)))
        texts += [text, " ".join(words[at:at + int(rng.integers(1, 12))])]
        labels += [none, none]
    words_only = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    for _ in range(600):  # shuffled notice words say nothing
        texts.append(" ".join(rng.choice(words_only, int(rng.integers(1, 5)))))
        labels.append(none)
    for w in words_only:  # nor does one of them said again and again
        texts += [" ".join([w] * int(k)) for k in rng.integers(2, 30, 3)]
        labels += [none] * 3
    labels = np.array(labels)
    second = np.array(second + [-1] * (len(labels) - len(second)))
    rows, cols, size = [], [], []
    for i, text in enumerate(texts):
        f = _features(text)
        rows.append(np.full(len(f), i)), cols.append(f), size.append(max(1, len(text.split())))
    rows, cols, scale = np.concatenate(rows), np.concatenate(cols), 1 / np.sqrt(np.array(size))
    held = rng.random(len(texts)) < 0.2
    used, cols = np.unique(cols, return_inverse=True)  # only slots that occur get weights
    weights, bias = np.zeros((len(used), none + 1), np.float32), np.zeros(none + 1, np.float32)
    target = np.eye(none + 1, dtype=np.float32)[labels]
    two = second >= 0
    target[two] = (target[two] + np.eye(none + 1, dtype=np.float32)[second[two]]) / 2
    share = np.where(labels == none, 1.0, 3.0) * ~held
    share, scale = (share / share.sum()).astype(np.float32), scale.astype(np.float32)
    order = np.argsort(cols, kind="stable")
    sorted_rows, first = rows[order], np.flatnonzero(np.diff(cols[order], prepend=-1))
    row_first = np.searchsorted(rows, np.arange(len(texts)))
    full = np.diff(np.append(row_first, len(rows))) > 0
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)

    def scores():
        s = np.zeros((len(texts), none + 1), np.float32)
        s[full] = np.add.reduceat(weights[cols], row_first[full], axis=0)
        return s * scale[:, None] + bias

    for _ in range(STEPS):  # gradient descent with momentum
        g = (_probabilities(scores()) - target) * share[:, None]
        speed_w = 0.9 * speed_w + np.add.reduceat((g * scale[:, None])[sorted_rows], first, axis=0)
        speed_b = 0.9 * speed_b + g.sum(axis=0)
        weights -= 8.0 * speed_w + 1e-5 * weights
        bias -= speed_b
    s, goal, other = scores()[held], target[held], labels[held]
    loss = lambda t: -(goal * np.log(_probabilities(s / t) + 1e-12)).sum(axis=1).mean()
    temperature = min(np.linspace(0.3, 3, 28), key=loss) if held.any() else 1.0
    p = _probabilities(s / temperature)
    own = [p[other != none, other[other != none]], p[second[held] >= 0, second[held][second[held] >= 0]]]
    own = np.concatenate(own)
    named = float(np.quantile(own, MISSED)) if len(own) else 0.0
    wrong = 1 - p[other == none, none]
    doubt = max(MIN_PROBABILITY, float(np.quantile(wrong, 1 - FALSE))) if len(wrong) else MIN_PROBABILITY
    table = np.zeros((1 << BITS, none + 1), np.float32)
    table[used] = weights
    return Model(table, bias, float(temperature), named, doubt)


def sample_paragraphs(docs: DataFrame, text_col: str = "text", n: int = SAMPLE) -> list[str]:
    """At most ``n`` different lines of at most ``SAMPLE_CHARS`` characters, lowest hashes first."""
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("p")) \
                .select(F.substring("p", 1, SAMPLE_CHARS).alias("p")).where("length(p) > 10")
    cells = 1 << 40
    mark = row_hash(F.col("p"))
    # the hash share that holds 2n different lines on average, so few besides the sample are dealt out
    cut = min(cells, 2 * n * cells // max(1, lines.select(mark).distinct().count()) + 1)
    part = lines.where(mark % cells < cut).distinct()
    return [r[0] for r in part.orderBy(mark % cells, "p").limit(n).collect()]


HITS = "array<struct<start:bigint,end:bigint,family:string,probability:double,contained:double>>"


def scan(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "licences") -> DataFrame:
    """``docs`` with ``out_col``: the notices (or "unknown" windows), with byte places in the
    folded text (its UTF-8 bytes), family, the window's probability and containment."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()),
                                ("probability", pa.float64()), ("contained", pa.float64())]))
    keep = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [fold(t) for t in part.column(0).to_pylist()]
                hits = _scan(texts, model)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(hits, kinds)], [*keep, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col(text_col), *keep).mapInArrow(run, ", ".join([*([schema] if schema else []), f"`{out_col}` {HITS}"]))


def _windows(first: np.ndarray, n: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the windows over pieces that start at ``first``: whole short pieces;
    long ones by ``width`` words, half overlapping."""
    last = np.append(first[1:], n)
    count = np.maximum(1, -(-(last - first - width) // (width // 2)) + 1)
    which = np.repeat(np.arange(len(first)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = first[which] + step * (width // 2)
    return a, np.minimum(a + width, last[which])


def _scan(texts: list[bytes], model: Model) -> list[list[dict]]:
    h, start, end, buf = word_hashes(texts)
    out = [[] for _ in texts]
    if not len(h):
        return out
    places = starts_of(texts)
    doc = np.searchsorted(places, start, side="right") - 1
    line = np.searchsorted(np.flatnonzero(np.frombuffer(buf, np.uint8) == 10), start)
    # a paragraph ends with its text or where a line without words follows
    new = (np.diff(line, prepend=-2) > 1) | (np.diff(doc, prepend=-1) != 0)
    first = np.flatnonzero(new)
    para, last = np.cumsum(new) - 1, np.append(first[1:], len(h))
    score = np.zeros((len(h) + 1, model.weights.shape[1]))
    pair = np.zeros_like(score)
    np.cumsum(model.weights[_slots(h)], axis=0, out=score[1:])
    pairs = combined(h, 2)
    if len(pairs):
        np.cumsum(model.weights[_slots(pairs)], axis=0, out=pair[1:-1])
    pair[-1] = pair[-2]
    a, b = _windows(np.flatnonzero(np.diff(line, prepend=-1)), len(h))
    wide_a, wide_b = _windows(first, len(h))
    across = line[wide_a] != line[wide_b - 1]
    wide_a, wide_b = wide_a[across], wide_b[across]
    near_a, near_b = _windows(first, len(h), WINDOW // 2)  # short notices amid other words
    n_lines, n_wide = len(a), len(a) + len(wide_a)
    a, b = np.concatenate([a, wide_a, near_a]), np.concatenate([b, wide_b, near_b])
    p = _probabilities(model.logits(score[b] - score[a] + pair[b - 1] - pair[a], b - a))
    sure = 1 - p[:, -1]
    known = model.known_bigrams(pairs)
    known[para[:-1] != para[1:]] = -1
    found = {}  # family -> (first word, end) of its notices, to name each one once
    seen = np.zeros(len(h), bool)  # words of windows that are reported
    # windows within lines first, so that those across line ends add only what these lack
    for i in np.flatnonzero(sure >= MIN_PROBABILITY):
        lo, hi = max(first[para[a[i]]], a[i] - WINDOW), min(last[para[a[i]]], b[i] + WINDOW)
        hits = [x for x in model.notices(known[lo:hi - 1], p[i]) if x[1] + lo < b[i] and x[2] + lo > a[i]]
        fresh = []
        for family, s, e, share in hits:
            old = found.setdefault(family, {})
            if not any(k in old for k in range(s + lo, e + lo)):
                fresh.append((family, s + lo, e + lo, share))
                old.update(dict.fromkeys(range(s + lo, e + lo)))
        if not hits and sure[i] >= model.doubt and (i < n_lines or i < n_wide and not seen[a[i]:b[i]].any()):
            fresh.append(("unknown", a[i], b[i], model.best_share(known[a[i]:b[i] - 1])))
        seen[a[i]:b[i]] = True
        at = doc[a[i]]
        for family, s, e, share in fresh:
            out[at].append({"start": int(start[s] - places[at]), "end": int(end[e - 1] - places[at]), "family": family,
                            "probability": float(sure[i]), "contained": float(share)})
    return [sorted(x, key=lambda hit: (hit["start"], hit["end"], hit["family"])) for x in out]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), train(sample_paragraphs(docs)))
    named = F.filter("licences", lambda x: x["family"] != "unknown")
    families = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["family"])))
    return found.select("doc_id", F.array_join(families, ",").alias("families"), F.size(named).cast("bigint").alias("n_hits"),
                        F.size(F.filter("licences", lambda x: x["family"] == "unknown")).cast("bigint").alias("n_unknown"),
                        F.round(F.array_max(F.transform("licences", lambda x: x["probability"])), 4).alias("probability"))
