"""Encoding texts with a public tokenizer inside Spark tasks.

Texts of one corpus repeat most of their words, and the tokenizers used here never merge
across white space.  So a text is cut where the tokenizer itself always cuts, each distinct
piece is encoded by the library once, and its ids are kept in a table of the worker that is bounded by
its bytes and serves all tasks of the worker.  The table is arrays, not objects; cutting, finding the pieces
of a slice of texts in it and putting the ids together work on arrays too; Python objects are made for
pieces that are not in the table only.
The ids are those of encoding the whole text; the tests compare both on random texts.
A tokenizer whose file shows neither of the two known cutting rules gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

CACHE = 12 << 20  # bytes of a worker's table of pieces and their ids
ENTRY = 20        # bytes of an entry besides text and ids
AT_ONCE = 2048    # new pieces encoded at once
DOCS, BYTES = 4096, 2 << 20  # documents and bytes of text encoded at once, at most (or one document)

# white space as the tokenizers' patterns take it: Unicode's, without the four separators
# that Python adds to it
_WS, _NW = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_PIECE = re.compile(rf" ?{_NW}+|{_WS}+(?!{_NW})|{_WS}+")
_WORD = re.compile(rf"{_NW}+")
_ODD = re.compile(r"[\x1c-\x1f]")
_RARE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # blanks beyond the six of ASCII
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# the bytes that lead a rare blank
_MAYBE = np.zeros(256, bool)
_MAYBE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# where a tokenizer lower-cases, A to Z may be so before without changing an id, except before combining
# marks (some compose with the small letter only), whose bytes begin with this one or a greater
_COMBINING = 0xCC
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MARKS = ".,;:!?"  # after a letter, the tokenizers always cut before one of these; not after
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in _MARKS]] = True


def _plain_words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        # the table: distinct pieces, their ids one after the other, number of ids and uses of each
        self.keys, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.many, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.cut = self.separator = None
        self.lower = False
        if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space"):
            self.cut, self.separator = _PIECE.findall, "\n"
        elif normal == ["NFC", "Replace", "Lowercase"] and steps[0].get("type") == "Split" \
                and steps[0].get("behavior") == "Removed" and spec.get("added_tokens"):
            self.cut, self.separator = _plain_words, spec["added_tokens"][0]["content"]
            self.lower = True
        # texts that hold an added token's own string are encoded whole: it cuts them elsewhere
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if self.separator:
            self.mark = self._ids([self.separator])[0]

    def _ids(self, texts):
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of distinct pieces: encoded joined by a
        separator of known id and split at that id."""
        plain = np.fromiter((not p.isspace() for p in pieces), bool, len(pieces))
        joined = [p for p, one in zip(pieces, plain) if one]
        many, ids = np.zeros(len(pieces), np.int32), np.zeros(0, "<u4")
        if joined and self.mark.size == 1:
            ids = self._ids([self.separator.join(joined)])[0]
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) == len(joined) - 1:
                many[plain] = np.diff(np.concatenate([[-1], at, [ids.size]])) - 1
                ids = np.delete(ids, at)
            else:
                plain[:], ids = False, ids[:0]
        else:
            plain[:] = False
        rest = self._ids([p for p, one in zip(pieces, plain) if not one])
        many[~plain] = [x.size for x in rest]
        out, mine = np.zeros(int(many.sum()), "<u4"), np.repeat(plain, many)
        out[mine] = ids
        out[~mine] = np.concatenate([ids[:0], *rest])
        return out, many

    def _learn(self, keys: pa.Array) -> None:
        """Take the pieces after the known ones into the table."""
        flat, many = [self.flat], [self.many]
        for lo in range(len(self.keys), len(keys), AT_ONCE):
            ids, counts = self._fresh(keys.slice(lo, AT_ONCE).to_numpy(zero_copy_only=False).tolist())
            flat.append(ids)
            many.append(counts)
        self.flat, self.many = np.concatenate(flat), np.concatenate(many)
        self.uses = np.append(self.uses, np.zeros(len(keys) - len(self.keys), np.int64))
        self.keys = keys

    def _forget(self) -> None:
        """Beyond the bound the most used half of the table stays; older uses count half."""
        size = pc.binary_length(self.keys).to_numpy().astype(np.int64) + 4 * self.many + ENTRY
        if size.sum() <= CACHE:
            return
        order = np.argsort(-self.uses, kind="stable")
        keep = np.zeros(len(order), bool)
        keep[order[np.cumsum(size[order]) <= CACHE // 2]] = True
        self.flat, self.keys = self.flat[np.repeat(keep, self.many)], self.keys.filter(pa.array(keep))
        self.many, self.uses = self.many[keep], self.uses[keep] // 2

    def _gather(self, pieces: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """The ids of the pieces between each two bounds."""
        known = len(self.keys)
        every = pa.concat_arrays([self.keys, pieces]).dictionary_encode()
        if len(every.dictionary) > known:
            self._learn(every.dictionary)
        which = every.indices.to_numpy()[known:]
        first = np.cumsum(self.many, dtype=np.int32) - self.many
        many = self.many[which]
        ends = np.zeros(len(many) + 1, np.int32)
        np.cumsum(many, out=ends[1:])
        at = np.repeat(first[which] - ends[:-1], many)
        at += np.arange(at.size, dtype=np.int32)
        tokens = self.flat[at]
        self.uses += np.bincount(which, minlength=self.uses.size)
        self._forget()
        at = ends[bounds].tolist()
        return [tokens[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return [x.tobytes() for x in self._ids(texts)]
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        # in any case: lower-casing before must not make an added token
        folded, whole = bytes(data).lower(), set()
        if any(a.encode().lower() in folded for a in self.added):
            whole = {i for i, t in enumerate(raw) if any(a.encode().lower() in t.lower() for a in self.added)}
        # only texts with one of these bytes can hold a rare blank
        odd = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(_MAYBE[data]), side="right")).tolist()
        rare = [i for i in odd if i not in whole and _RARE.search(texts[i])]
        for i in whole.union(rare):
            raw[i], sizes[i] = b"", 0
        out = self._arrays(np.frombuffer(b"".join(raw), np.uint8) if whole or rare else data, sizes)
        if whole:
            for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
                out[i] = ids.tobytes()
        if rare:
            cut = [self.cut(texts[i]) for i in rare]
            pieces = pa.array(list(chain.from_iterable(cut)), pa.string())
            for i, ids in zip(rare, self._gather(pieces, np.cumsum([0, *map(len, cut)]))):
                out[i] = ids
        return out

    def _arrays(self, data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The same for the bytes of texts whose only blanks are the six of ASCII, on arrays."""
        if not data.size:
            return [b""] * len(sizes)
        at = np.cumsum(sizes) - sizes
        if self.lower:
            keep, data = data, _LOWER[data]
            marked = np.flatnonzero(keep >= _COMBINING)
            if marked.size:
                high = np.zeros(len(sizes), bool)
                high[np.searchsorted(at + sizes, marked, side="right")] = True
                data = np.where(np.repeat(high, sizes), keep, data)
        head = np.zeros(data.size, bool)
        head[at[sizes > 0]] = True
        blank = _BLANK[data]
        after_blank = np.empty_like(blank)  # is the byte before, in the same text, a blank?
        after_blank[0], after_blank[1:] = False, blank[:-1]
        after_blank &= ~head
        words = ~blank & (head | after_blank)
        # a mark after a plain letter at the end of a word is a piece of its own
        tail = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
        ending = np.append(blank[1:] | head[1:], True)
        tail = tail[ending[tail] & ~head[tail]]
        words[tail] = True
        if self.lower:  # pieces are the words
            start = np.flatnonzero(words)
            dense = np.cumsum(~blank, dtype=np.int32)
            offsets = np.append(dense[start] - 1, dense[-1])
            body = data[~blank]
        else:  # a word takes one space before it; other blanks are pieces up to the last one before a word
            cut = head | (blank & ~after_blank) | words
            inner = np.flatnonzero(words & after_blank)
            cut[inner - 1] = True
            cut[inner[data[inner - 1] == 0x20]] = False
            start = np.flatnonzero(cut)
            offsets = np.append(start, data.size)
            body = data
        if not start.size:
            return [b""] * len(sizes)
        pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)),
                                             pa.py_buffer(np.ascontiguousarray(body)))
        return self._gather(pieces, np.searchsorted(start, np.append(at, data.size)))


_KEPT: dict[tuple, Encoder] = {}  # the last encoder of this worker, for its next tasks


def kept_encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; tasks that a worker runs one after the other share its table."""
    state = os.stat(path)
    key = path, state.st_mtime_ns, state.st_size
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(path)
    return _KEPT[key]


def encoded(batches, path: str):
    """For Arrow batches of (id, text, ...): yields (ids column slice, [bytes]) per group of documents."""
    encoder = kept_encoder(path)
    for batch in batches:
        for lo, n in slices(batch.column(1), DOCS, BYTES):
            part = batch.slice(lo, n)
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield part, encoder.encode(texts)


def binary(values) -> pa.Array:
    return pa.array(values, type=pa.binary())
