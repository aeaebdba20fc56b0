"""Language ID by cross-parsing entropy.

Per language, a suffix automaton of a bounded sample of labelled text accepts
every substring of that sample. A text is parsed greedily into longest matches;
the number of phrases, times log2 of the sample's length, over the text's length
estimates the cross entropy, and the language with the least wins.

Many texts are parsed side by side: the automaton becomes a table
(state, character class) -> next state, where a missing transition ends the
phrase and starts the next one at the root. Texts are cut into blocks of BLOCK
characters, each of which starts a phrase; all of a text is parsed.

Null text or no letter: `und`, score 0. Ties go to the smaller name. Without any
labelled row, everything is `und`. Null doc_id: predicted, never learned from.
Repeated rows get equal results. Very long texts are cut into blocks like others.
An empty table gives no row. Extra columns are kept, but for lang_pred and score,
which are replaced.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_chunks, tune

#: Bounds of the training sample: documents of a language, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 48, 400
#: Letters that get a class of their own.
LETTERS = 56
BLOCK = 256


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))



def training_sample(docs: DataFrame) -> dict[str, str]:
    """Language -> text, from labelled documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    ids = [r.doc_id for r in picked.select("doc_id").distinct().collect()]
    out: dict[str, list] = {}
    for r in rows.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).where("text is not null").collect():
        out.setdefault(r.lang, []).append((r.doc_id, r.text))
    return {k: "\n".join(t for _, t in sorted(v)[: 2 * SAMPLE_DOCS]) for k, v in sorted(out.items())}


def suffix_automaton(codes: list[int], classes: int) -> np.ndarray:
    """Transitions (state, class) -> state, -1 where there is none; state 0 is the root."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(step), classes), -1, np.int32)
    for s, row in enumerate(step):
        for c, t in row.items():
            table[s, c] = t
    return table


class Parser:
    """Counts phrases of texts against each language's automaton."""

    def __init__(self, sample: dict[str, str]) -> None:
        self.langs = sorted(sample)
        common = Counter(c for t in sample.values() for c in t.lower() if c.isalpha()).most_common(LETTERS)
        self.classes = len(common) + 3
        other, digit = len(common) + 1, len(common) + 2
        self.lut = np.zeros(sys.maxunicode + 1, np.uint8)
        chosen = {c: i + 1 for i, (c, _) in enumerate(common)}
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                self.lut[cp] = chosen.get(ch.lower(), other)
            elif ch.isdigit():
                self.lut[cp] = digit
        self.letter = np.ones(self.classes, bool)
        self.letter[[0, digit]] = False
        tables, self.roots, self.weight, base = [], [], [], 0
        for lang in self.langs:
            codes = self.lut[np.frombuffer(sample[lang].encode("utf-32-le"), np.uint32)]
            t = suffix_automaton(codes.tolist(), self.classes)
            root = np.where(t[0] >= 0, t[0], 0)
            ends = t < 0
            goes = np.where(ends, root[None, :], t)
            tables.append(((goes.astype(np.int64) * self.classes + base) << 1 | ends).ravel())
            self.roots.append(base)
            self.weight.append(np.log2(max(len(codes), 2)))
            base += t.size
        kind = np.int32 if 2 * base < 2**31 else np.int64  # several hundred languages need more
        self.table = np.concatenate([t.astype(kind) for t in tables]) if tables else np.zeros(0, np.int32)
        self.weight = np.array(self.weight)

    def phrases(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(text, language) -> phrases; codes of all texts in a row, text i from off[i] to off[i + 1]."""
        sizes = np.diff(off)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[:-1][owner] + nth * BLOCK
        size = np.minimum(BLOCK, off[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        out = np.zeros((len(sizes), len(self.langs)))
        if not len(start):
            return out
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        columns = np.zeros((size[0], len(start)), np.int32)
        for t in range(size[0]):
            columns[t, : active[t]] = codes[start[: active[t]] + t]
        for k, root in enumerate(self.roots):
            state = np.full(len(start), root, self.table.dtype)
            count = np.ones(len(start), np.int32)
            for t in range(size[0]):
                m = active[t]
                got = self.table.take(state[:m] + columns[t, :m])
                count[:m] += got & 1
                np.right_shift(got, 1, out=state[:m])
            out[:, k] = np.bincount(owner, count, len(sizes))
        return out

    def predict(self, codes: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = np.maximum(np.diff(off), 1)
        seen = np.concatenate([[0], np.cumsum(self.letter[codes])])
        has_letter = seen[off[1:]] > seen[off[:-1]]
        if not self.langs:
            return ["und"] * (len(off) - 1), np.zeros(len(off) - 1)
        rate = self.phrases(codes, off) * self.weight / n[:, None]
        best = rate.argmin(1)
        if len(self.langs) > 1:
            two = np.partition(rate, 1, axis=1)[:, :2]
            score = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0)
        else:
            score = np.ones(len(best))
        return [self.langs[i] if ok else "und" for i, ok in zip(best, has_letter, strict=True)], np.where(has_letter, np.clip(score, 0, 1), 0)


_PARSERS: dict[int, Parser] = {}


def _parser(sample: dict[str, str]) -> Parser:
    key = hash(tuple(sample.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(sample)
    return _PARSERS[key]


def add_language(docs: DataFrame, sample: dict[str, str] | None = None) -> DataFrame:
    """docs with lang_pred and score beside; the sample is learned from docs unless given."""
    spark = tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(training_sample(docs) if sample is None else sample)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for b in batches:
            preds, scores = [], []
            for _, data, off in text_chunks(b.column(at).cast(pa.large_string())):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                codes = parser.lut[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
                p, s = parser.predict(codes, chars[off])
                preds += p
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
