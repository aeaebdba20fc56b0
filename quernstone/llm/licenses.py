"""License scans by diagonal voting.

All rolling word 2-gram hashes of all texts are joined with the positions of the
same hashes in a fixed list of templates. Hits of one document and template vote
for the diagonal `position in document - position in template`; neighbouring
diagonals are merged, so that a span with a few words put in or left out stays
one span; spans are verified by a second, independent hash of each gram and by
the share of the template that they cover.

Null or empty text: no words, no hits. Repeated rows give repeated results.
Extra columns are ignored. Null doc_id: kept as a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, gram_hash, lean, numbered, text_chunks, tune, word_hashes

#: Phrases that give a base label wherever their words stand consecutively.
BASE_PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Wording of public licences and notices, with labels of the method's own.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution", "cc"),
    ("licensed under cc by", "cc"),
    ("licensed under cc by nc", "cc-nc"),
    ("all rights reserved", "all-rights-reserved"),
]
GRAM = 2
#: A template of the method's own counts when a span covers this share of its words.
MIN_COVER = 0.75
#: Diagonals up to this far apart belong to one span.
MAX_SHIFT = 3
#: Joined like a gram, to carry each document's number of words; no gram hashes to it but by chance 2**-64.
MARK = 0


def _templates(spark):
    rows = [(MARK, MARK, -1, 0)]
    for t, (text, _) in enumerate(BASE_PHRASES + TEMPLATES):
        words = text.split()
        h, v = (word_hashes(words, s) for s in (11, 23))
        for i in range(len(words) - GRAM + 1):
            rows.append((int(gram_hash([h[i + j: i + j + 1] for j in range(GRAM)]).view(np.int64)[0]), int(gram_hash([v[i + j: i + j + 1] for j in range(GRAM)]).view(np.int64)[0]), t, i))
    return spark.createDataFrame(rows, "h long, tv long, tpl int, tpos int")


@lean
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rid = b.column(1), np.asarray(b.column(0))
        for first, data, off in text_chunks(b.column(2)):
            w = Words(data, off, ALNUM, (11, 23))
            at, h = w.grams(GRAM, 0)
            _, v = w.grams(GRAM, 1)
            n = len(off) - 1
            rows = np.concatenate([w.row[at], np.arange(n)]) + first
            pos = np.concatenate([w.pos[at], np.diff(w.bounds)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[rows]), ids.take(pa.array(rows)), pa.array(pos.astype(np.int32)), pa.array(np.concatenate([h, np.full(n, MARK, np.uint64)]).view(np.int64)), pa.array(np.concatenate([v, np.full(n, MARK, np.uint64)]).view(np.int64))],
                names=["_row", "doc_id", "pos", "h", "v"],
            )


def spans_of(hits: list[tuple[int, int, int, list[int]]]) -> dict:
    """hits: (template, diagonal, votes, template positions hit) of one document."""
    base, own, best = [], {}, 0.0
    by_template: dict[int, list] = {}
    for t, *rest in hits:
        by_template.setdefault(t, []).append(rest)
    for t, rows in by_template.items():
        text, label = (BASE_PHRASES + TEMPLATES)[t]
        size = len(text.split())
        if t < len(BASE_PHRASES):
            base += [(d, label) for d, votes, _ in rows if votes == size - GRAM + 1]
            continue
        rows.sort()
        group: list = []
        for row in [*rows, None]:
            if row is None or group and row[0] - group[-1][0] > MAX_SHIFT:
                covered = set()
                for _, _, seen in group:
                    for p in seen:
                        covered.update(range(p, p + GRAM))
                share = len(covered) / size
                if share >= MIN_COVER:
                    own[label] = max(own.get(label, 0.0), share)
                group = []
            if row is not None:
                group.append(row)
    if base:
        best = 1.0
    best = max([best, *own.values()])
    return {
        "n_base": len(base),
        "first_word": min((d for d, _ in base), default=None),
        "last_word": max((d for d, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({x for _, x in base} | set(own))),
        "score": float(best),
    }


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    for b in batches:
        rows = []
        for doc_id, n, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            got = spans_of([(h["tpl"], h["diagonal"], h["votes"], h["seen"]) for h in hits])
            rows.append({"doc_id": doc_id, "n_words": n, **got})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base phrase places, labels and the best score."""
    spark = tune(docs.sparkSession)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("_row", "doc_id", "text")
    grams = rows.mapInArrow(_grams, "_row long, doc_id long, pos int, h long, v long")
    hits = grams.join(F.broadcast(_templates(spark)), "h").where(F.col("v") == F.col("tv"))
    votes = hits.groupBy("_row", "doc_id", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("seen"))
    mark = F.col("tpl") == -1
    by_doc = votes.groupBy("_row", "doc_id").agg(
        F.max(F.when(mark, F.col("diagonal"))).cast("long").alias("n_words"),
        F.collect_list(F.when(~mark, F.struct("tpl", "diagonal", "votes", "seen"))).alias("hits"),
    )
    return by_doc.select("doc_id", "n_words", "hits").mapInArrow(_verify, _OUT)
