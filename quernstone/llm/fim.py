"""Fill-in-the-middle: documents cut in three and put together in another order.

Both cuts of a document and its form come from a hash of its doc_id, so that a
lost task gives the same rows again. A kernel cuts all rows of an Arrow batch at
once on their UTF-8 bytes: a lookup of byte classes marks where code points begin,
running sums of the marks, less what stood before the row, count them, and one
searchsorted finds the bytes of every cut. Sentinels in texts are found by one
comparison of neighbouring bytes.

A unit is a code point. Null text counts as empty and gives the plain form, as do
texts that hold a sentinel, which makes restoring exact. Null doc_id hashes as the
empty string. Repeated rows give equal rows. Very long texts take time and memory
in proportion to their bytes. An empty table gives no row. Extra columns are kept,
but for the columns of ADDED, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, lean, text_chunks, tune

#: Sentinels before the prefix, the suffix and the middle; each a letter between < and >.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut; and of those, the ones with the suffix first.
FIM_RATE, SPM_RATE = 90, 20
SEED = 1
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]

#: Classes of bytes: the first of a code point, and the letters of sentinels.
_STARTS = (np.arange(256) & 0xC0) != 0x80
_LETTERS = np.isin(np.arange(256), [ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)])


def draws(doc_ids: list[int | None], seed: int = SEED) -> np.ndarray:
    """Four unsigned 32-bit numbers of each doc_id: the first groups of the hash of seed:doc_id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def with_sentinel(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row's bytes hold a sentinel."""
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTERS[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    # those that begin in the row, but for its last two bytes
    return np.searchsorted(at, np.maximum(off[1:] - 2, off[:-1])) > np.searchsorted(at, off[:-1])


def cuts(data: np.ndarray, off: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, cuts in code points, cuts in bytes) of each row; two cuts a row."""
    seen = np.cumsum(_STARTS[data], dtype=np.int64)
    before = np.concatenate([[0], seen])[off]
    n = np.diff(before)
    unit = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # the byte that begins code point u of the row; past the last one, the row's end
    byte = np.minimum(np.searchsorted(seen, before[:-1, None] + unit + 1), off[1:, None])
    return n, unit, byte


def _arranged(data: np.ndarray, off: np.ndarray, byte: np.ndarray, form: np.ndarray) -> pa.Array:
    """The output texts of rows; form is 0 for plain, 1 for psm, 2 for spm."""
    raw, out = memoryview(data), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for a, (x, y), z, f in zip(off[:-1].tolist(), byte.tolist(), off[1:].tolist(), form.tolist(), strict=True):
        if f == 0:
            out.append(raw[a:z])
        elif f == 1:
            out += (p, raw[a:x], s, raw[y:z], m, raw[x:y])
        else:
            out += (s, raw[y:z], p, raw[a:x], m, raw[x:y])
    ends = np.cumsum(np.diff(off) + (form > 0) * len(p + s + m))
    return pa.StringArray.from_buffers(len(form), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(b"".join(out)))


def _kernel(seed: int):
    forms = np.array(["plain", "psm", "spm"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for row, data, off in text_chunks(b.column(1)):
                rows = len(off) - 1
                h = draws(ids[row:row + rows], seed)
                n, unit, byte = cuts(data, off, h)
                cut = (n > 0) & (h[:, 2] % 100 < FIM_RATE) & ~with_sentinel(data, off)
                form = np.where(cut, np.where(h[:, 3] % 100 < SPM_RATE, 2, 1), 0)
                length = lambda x: pa.array(x, pa.int64(), mask=~cut)  # noqa: B023, E731
                out = [pa.array(n, pa.int64()), pa.array(forms[form], pa.string()), length(unit[:, 0]), length(unit[:, 1] - unit[:, 0]), _arranged(data, off, byte, form)]
                kept = [b.column(i).slice(row, rows) for i in range(b.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*kept, *out], names=[*[b.schema.names[i] for i in range(b.num_columns) if i != 1], *ADDED])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs without text, and its code points n, form, prefix_chars, middle_chars (null if plain) and output."""
    tune(docs.sparkSession)
    docs = docs.drop(*ADDED)
    (key,) = free_names(docs, "key")
    rest = [c for c in docs.columns if c.lower() != "text"]
    df = docs.select(F.col("doc_id").cast("long").alias(key), F.col("text").cast("string").alias("text"), *rest)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.mapInArrow(_kernel(seed), f"{kept}, n long, form string, prefix_chars long, middle_chars long, output string").drop(key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    No sentinel stands in the parts, and none can arise where parts meet, as a
    sentinel has its < at the front alone; so the first occurrences are the marks.
    """
    size, psm = len(PREFIX), form == "psm"
    second = F.when(psm, F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    head = F.substr(output, F.lit(size + 1), second - size - 1)
    rest = F.substr(output, second + size)
    third = F.instr(rest, MIDDLE)
    tail, middle = F.substr(rest, F.lit(1), third - 1), F.substr(rest, third + size)
    return F.when(psm, F.concat(head, middle, tail)).when(form == "spm", F.concat(tail, middle, head)).otherwise(output)
