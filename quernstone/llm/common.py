"""Shared helpers: session settings, checkpoints, and numpy kernels over Arrow text.

Texts are handled as the UTF-8 bytes of an Arrow batch, so that splitting into
words and hashing them costs a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call handles (a longer document makes its own chunk).
CHUNK_BYTES = 1 << 20
#: Batches that a kernel gives before its free memory goes back.
LEAN = 8
#: Rows of an Arrow batch sent to a Python worker; bounds the worker's memory.
ARROW_ROWS = 1000

_M1, _M2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, so that a worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one in local mode alone, where all tasks share the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared')}"
    return base.rstrip("/")


#: Folders of intermediate tables, by application.
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path for intermediate tables that all executors share; it stays until clean()."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_base(spark)}/{app}-{np.random.default_rng().integers(1 << 62):x}"
    _MADE.setdefault(app, []).append(folder)
    return folder


def clean(spark: SparkSession) -> int:
    """Delete what the operators of this session still keep, results included, and tell how many folders; results must be written elsewhere before."""
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    for f in folders:
        remove_folder(spark, f)
    return len(folders)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one call, in a shared folder of their own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, shared_folder(spark)
        self.names: list[str] = []
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back, which cuts its lineage."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        self.made += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables."""
        for name in names:
            remove_folder(self.spark, f"{self.folder}/{name}")
            self.names.remove(name)

    def only(self, *names: str) -> None:
        """Delete all tables but the named ones."""
        self.drop(*[n for n in self.names if n not in names])


#: Ids that may be broadcast, 8 bytes each.
FEW_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in the one column of ids, a stored table; rows without doc_id stay.

    Up to FEW_IDS ids are broadcast, so that no text moves; more are joined by a shuffle.
    """
    gone = ids.toDF("_gone").where("_gone is not null").distinct()
    few = gone.limit(FEW_IDS + 1).count() <= FEW_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hand_back() -> None:
    """Give free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the GNU C library alone
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A kernel over Arrow batches that hands its worker's free memory back now and then, and when a task ends, as workers live on."""

    @wraps(run)
    def wrapped(batches):
        for i, b in enumerate(run(batches), 1):
            yield b
            if i % LEAN == 0:
                _hand_back()
        _hand_back()

    return wrapped


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}") in taken or f"{name}2" in taken:
            pass
        out.append(name)
    return out


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Give each row its own number, so that repeated doc_ids stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n 64-bit values by rule from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self) -> None:
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = _Powers()


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
#: Bytes of words: 0-9, a-z (after lower-casing) and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words between ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False

_BYTE_CODES = {seed: random_words(256, seed) for seed in (11, 23)}


def text_chunks(batch_text: pa.Array):
    """Yield (first row, bytes, offsets) over the rows of a text column; null counts as empty."""
    col = batch_text.combine_chunks() if isinstance(batch_text, pa.ChunkedArray) else batch_text
    col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset:]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield row, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


class Words:
    """Words of a chunk: their byte spans, owning rows and hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray, seeds=(11,)) -> None:
        self.low = LOWER[data]
        flag = is_word[self.low]
        prev = np.empty_like(flag)
        if len(flag):
            prev[0] = False
            prev[1:] = flag[:-1]
            first = off[:-1][off[:-1] < len(flag)]
            prev[first] = False
        self.start = np.flatnonzero(flag & ~prev)
        nxt = np.empty_like(flag)
        if len(flag):
            nxt[-1] = False
            nxt[:-1] = flag[1:]
            last = off[1:][off[1:] > 0] - 1
            nxt[last] = False
        self.end = np.flatnonzero(flag & ~nxt) + 1
        #: Words of row r are those from bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.bounds))
        self.pos = np.arange(len(self.start)) - self.bounds[:-1][self.row] if len(self.start) else np.zeros(0, np.int64)
        self.hash = [span_hash(self.low, self.start, self.end, s) for s in seeds]

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words within a row."""
        h, n = self.hash[seed], len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1:])
        out = gram_hash([h[i: n - k + 1 + i][at] for i in range(k)])
        return at, out


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Ordered combination of word hashes."""
    out = np.zeros_like(parts[0])
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * np.uint64(_M2) + p + np.uint64(len(parts)))
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 11) -> np.ndarray:
    """Hashes of byte spans, by prefix sums of a polynomial mod 2**64."""
    up, down = _POWERS.upto(len(data))
    with np.errstate(over="ignore"):
        acc = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[seed][data] * up[: len(data)], out=acc[1:])
        return mix((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(words: list[str], seed: int = 11) -> np.ndarray:
    """Hashes of given words, as Words has them."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return span_hash(LOWER[data], np.concatenate([[0], end[:-1]]).astype(np.int64), end.astype(np.int64), seed)
