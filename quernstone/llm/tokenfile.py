"""Token-id output: whole documents as ids in order of doc_id, in range-coded segments.

Rows are dealt into ranges of doc_id and sorted; each partition encodes its texts
with the tokenizers library, appends an end id to each document and codes the ids
into segments (see rangecoder) that never split a document. Each segment is one
row of a Parquet table in a folder that all executors share, beside a directory
of its documents, so that commits of tasks, retries and any Hadoop file system
come from Spark's own writer. Reading decodes each block under its checksum.

Null or empty text gives only the end id. Rows with equal doc_id are ordered by
the text's hash; null doc_ids come first. Extra columns are ignored. An empty
table gives no segment and no row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Encoder
from .common import lean, shared_folder, text_chunks, tune
from .rangecoder import decode_segment, encode_segment

#: A segment is closed when it holds this many ids.
SEGMENT_IDS = 4 << 20

_FILE = "part int, segment int, before long, n_ids long, doc_ids binary, sizes binary, nulls binary, blocks binary"

_ENCODERS: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """The worker's encoder by the tokenizers library: each distinct word is encoded once."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            if not words:
                return np.zeros(0, np.int32), np.zeros(0, np.int64)
            got = t.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
            return np.array(got.ids, np.int32), np.bincount(got.word_ids, minlength=len(words))

        _ENCODERS[path] = Encoder(encode, [a.content.encode() for a in t.get_added_tokens_decoder().values()])
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, out: str, end_id: int) -> None:
    """Write the ids of all texts to the folder out."""
    tune(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = library_encoder(path), TaskContext.get().partitionId()
        ids, sizes, names, held, before, segment = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            known = pa.concat_arrays(names)
            n = np.concatenate(sizes).astype("<i8")
            row = [[part], [segment], [before], [held], [np.asarray(known.fill_null(0)).astype("<i8").tobytes()], [n.tobytes()], [np.asarray(known.is_null()).tobytes()], [encode_segment(np.concatenate(ids))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "segment", "before", "n_ids", "doc_ids", "sizes", "nulls", "blocks"])

        for b in batches:
            for first, data, off in text_chunks(b.column(1)):
                flat, n = encode(data, off)
                at = np.cumsum(n)
                got = np.insert(flat, at, end_id).astype(np.int32)
                ids.append(got)
                sizes.append(n + 1)
                names.append(b.column(0).slice(first, len(n)))
                held += len(got)
                if held >= SEGMENT_IDS:
                    yield close()
                    before, segment = before + held, segment + 1
                    ids, sizes, names, held = [], [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(run, _FILE).write.option("compression", "none").parquet(out)


def read_ids(spark: SparkSession, folder: str, *, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and with keep, ids) of each document of a written folder."""
    segments = spark.read.schema(_FILE).parquet(folder)
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    shared = spark.sparkContext.broadcast(base)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                ids = decode_segment(row["blocks"]).astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<i8")
                if len(ids) != row["n_ids"] or sizes.sum() != len(ids):
                    raise ValueError("a segment and its directory do not match")
                stop = np.cumsum(sizes)
                start = stop - sizes
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(start.tolist(), stop.tolist(), strict=True)]
                cols = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool)),
                    pa.array(start + row["before"] + shared.value[row["part"]]),
                    pa.array(sizes), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(start, stop[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    columns = "part int, before long, n_ids long, doc_ids binary, sizes binary, nulls binary, blocks binary"
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep
    return segments.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(run, out)


def token_file(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the ids of docs to folder (a new shared one unless given) and read them back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    write_ids(docs, path, folder, end_id)
    return read_ids(spark, folder)
