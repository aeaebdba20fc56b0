"""Byte-level BPE: encoding by per-prefix dynamic programming, and decoding.

A vocabulary automaton with suffix links (Aho-Corasick over the tokens' bytes)
lists all tokens that end at each byte of a word. For each prefix of the word
exactly one of them can be the last token of the prefix's encoding: the one that
is compatible, as a pair, with the stored last token of what it leaves. Following
the stored tokens back from the end of the word gives the exact ids.

Texts are cut into words by the byte-level pattern with numpy, words are numbered
through a hash table in the worker, and each distinct word is encoded once.
Only vocabulary files with the byte-level pre-tokenizer of that pattern are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, span_hash, text_chunks, tune

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: A worker's table of words: bits of its size at first and at most, and how full it may get before it grows or starts afresh.
FIRST_BITS, TABLE_BITS, TABLE_LOAD = 16, 21, 0.55


def byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte, as byte-level vocabularies write them -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        back = byte_chars()
        self.ids = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.added = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        self.bytes = [b""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for k, v in (self.ids | self.added).items():
            self.bytes[v] = k
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Tokens are numbered by age: single bytes first, then merges by rank.
        order = [k for k in self.ids if len(k) == 1]
        left, right = list(range(len(order))), list(range(len(order)))
        age = {k: i for i, k in enumerate(order)}
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = bytes(back[c] for c in a), bytes(back[c] for c in b)
            if a + b not in age:
                age[a + b] = len(left)
                left.append(age[a])
                right.append(age[b])
            self.merged.setdefault((age[a], age[b]), age[a + b])
        self.age, self.left, self.right = age, left, right
        self.id_of_age = [self.ids[k] for k in age]
        self.automaton = ahocorasick.Automaton()
        for k, a in age.items():
            self.automaton.add_word(k.decode("latin-1"), (a, len(k)))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are, none of their bytes merging across."""
        key = a << 32 | b
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > 100_000:
                self._pairs.clear()
            got = self._pairs[key] = self._check(a, b)
        return got

    def _check(self, a: int, b: int) -> bool:
        # Undo the newest merge on either side of the border, until a merge across
        # it would have come before the one undone, or both sides are single bytes.
        newest = len(self.left)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < newest:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                newest, a = a, self.right[a]
            else:
                newest, b = b + 1, self.left[b]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if word in self.added:
            return [self.added[word]]
        last: list[tuple[int, int] | None] = [None] * len(word)
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end] is None:
                at = end - size
                if at < 0 or (before := last[at]) is not None and self.compatible(before[0], token):
                    last[end] = (token, size)
        out, at = [], len(word) - 1
        while at >= 0:
            token, size = last[at]
            out.append(self.id_of_age[token])
            at -= size
        return out[::-1]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def _classes() -> np.ndarray:
    lut = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            lut[cp] = _LETTER
        elif kind == "N":
            lut[cp] = _NUMBER
        elif kind == "Z":
            lut[cp] = _SPACE
    lut[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    return lut


#: Endings that the pattern takes with their apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def word_spans(data: np.ndarray, off: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the words of all texts, and for each text the index of its first word."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _classes()[cp]
    hard = np.zeros(n + 1, bool)  # a text or an added token begins
    hard[np.searchsorted(at, off)] = True
    inside = None
    raw = data.tobytes() if added else b""
    for token in added:
        p = raw.find(token)
        while p >= 0:
            a, b = np.searchsorted(at, [p, p + len(token)])
            if not hard[a + 1:b].any():
                hard[a] = hard[b] = True
                inside = np.zeros(n, bool) if inside is None else inside
                inside[a + 1:b] = True
            p = raw.find(token, p + len(token))
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= hard[:n]
    blank = cp == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~hard[:n] & (kind != _SPACE)
    start = run & ~after_blank
    # the last of several white-space characters goes with what follows, or alone
    lone = np.zeros(n, bool)
    lone[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~hard[1:n]
    start |= lone
    quotes = np.flatnonzero((cp == 0x27) & start)
    for q in quotes:
        for e in _ENDINGS:
            stop = q + 1 + len(e)
            if stop <= n and not hard[q + 1:stop].any() and all(cp[q + 1 + i] == ord(c) for i, c in enumerate(e)):
                start[q + 1] = False
                if stop < n:
                    start[stop] |= kind[stop] == _LETTER
                break
    if inside is not None:
        start &= ~inside
        start |= hard[:n]
    first = np.flatnonzero(start)
    return at[first], np.searchsorted(at[first], off)


class Encoder:
    """Ids of whole texts; encode gives the ids of words that were not met before."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], added: list[bytes]) -> None:
        #: encode gives the ids of all words in a row, and the number of each word's.
        self.encode, self.added = encode, added
        self._reset()

    def _reset(self) -> None:
        self.bits = FIRST_BITS
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.size = 0

    def _grow(self, words: int) -> None:
        """Make room for so many words, as far as the table may grow."""
        while self.bits < TABLE_BITS and words > TABLE_LOAD * (1 << self.bits):
            self.bits += 1
        if len(self.keys) < 1 << self.bits:
            known = np.flatnonzero(self.keys)
            keys, vals = self.keys[known], self.vals[known]
            self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, vals)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 where unknown."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.vals[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.vals[slot[won]] = number[left[won]]
            go = ~won
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        start, first = word_spans(data, off, self.added)
        end = np.append(start[1:], len(data))
        h = span_hash(data, start, end) | np.uint64(1)
        if self.size > TABLE_LOAD * (1 << TABLE_BITS):
            self._reset()
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            self._grow(self.size + len(keys))
            if self.size + len(keys) > 0.8 * (1 << TABLE_BITS):
                self._reset()
                return self(data, off) if len(keys) < 0.7 * (1 << TABLE_BITS) else self._halves(data, off)
            raw = data.tobytes()
            which = new[at]
            ids, sizes = self.encode([raw[a:z] for a, z in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            self.flat = np.concatenate([self.flat, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self._put(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
            self.size += len(keys)
            number[new] = self._find(h[new])
        begin, sizes = self.start[number], (self.start[1:] - self.start[:-1])[number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], sizes)]
        return ids, np.diff(total[first])

    def _halves(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # one text with more distinct words than the table holds: encode it without the table
        raw = data.tobytes()
        out = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            start, _ = word_spans(data[a:b], np.array([0, b - a]), self.added)
            end = np.append(start[1:], b - a)
            out.append(self.encode([raw[a + s:a + e] for s, e in zip(start, end, strict=True)])[0])
        return np.concatenate(out), np.array(list(map(len, out)))


_ENCODERS: dict[str, Encoder] = {}


def dp_encoder(path: str) -> Encoder:
    """The worker's encoder by per-prefix dynamic programming."""
    if path not in _ENCODERS:
        v = vocabulary(path)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = list(map(v.encode_word, words))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

        _ENCODERS[path] = Encoder(encode, list(v.added))
    return _ENCODERS[path]


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """Text of ids; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, path: str, *, keep: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256; with keep, ids (array of
    int) and decoded (string) as well. Null text counts as empty: no ids, ''.
    Repeated rows get equal results; extra columns are ignored.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, encode = vocabulary(path), dp_encoder(path)
        shown = [str(i) for i in range(len(vocab.bytes))]
        for b in batches:
            for first, data, off in text_chunks(b.column(1)):
                flat, counts = encode(data, off)
                at, rows = 0, []
                for n in counts.tolist():
                    ids = flat[at:at + n].tolist()
                    at += n
                    text = decode(vocab, ids)
                    row = (n, hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, ids, text) if keep else row)
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(counts)), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols) + 1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
