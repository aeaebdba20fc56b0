"""Places for data that outlives a job: folders of a session, and journals whose next entry one writer alone can publish."""

from __future__ import annotations

import json
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


class Conflict(ValueError):
    """Somebody else has published meanwhile, or a record is at another revision than the caller saw."""


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one in local mode alone, where all tasks share the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared')}"
    return base.rstrip("/")


#: Folders made for intermediate tables, by application.
_MADE: dict[str, list[str]] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables; it goes with clean(), or else when the driver's JVM ends in order."""
    folder = f"{shared_base(spark)}/{spark.sparkContext.applicationId}-{uuid4().hex}"
    at, fs = _at(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clean(spark: SparkSession) -> int:
    """Delete all intermediate tables of this session and tell how many folders; results that still read them must be written before."""
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    for f in folders:
        remove(spark, f)
    return len(folders)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    at, fs = _at(spark, path)
    return fs.getContentSummary(at).getLength()


class Journal:
    """Numbered entries, each a small JSON text that is there as a whole or not at all.

    An entry is written beside the journal and renamed to its number, which fails if
    the number is taken: of several writers that saw the same last entry, one gets
    on. Numbers have no gaps, so that the last one is found by a few looks and no
    listing. The rename is atomic on file systems on which Spark's own checkpoints are.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, (at, self._fs) = spark, _at(spark, folder)
        self.folder = self._fs.makeQualified(at).toString()
        self._known = 0

    def _path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number:020d}.json")

    def last(self) -> int:
        """The last entry's number, 0 if there is none."""
        low, step = self._known, 1
        while self._fs.exists(self._path(low + step)):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._fs.exists(self._path(mid)) else (low, mid)
        self._known = low
        return low

    def get(self, number: int) -> dict:
        stream = self._fs.open(self._path(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def append(self, number: int, entry: dict) -> int:
        """Publish entry as number, which must be the next one; Conflict if another writer was first."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(json.dumps(entry).encode())
        out.close()
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        never = gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, self._path(number), never)
        except Exception as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(self._path(number)):
                raise Conflict(f"entry {number} has been published meanwhile") from e
            raise
        return number

    def last_with(self, key: str, value: int) -> int:
        """The last number whose entry has key at most value; entries never go down in key. 0 if there is none."""
        low, high = 0, self.last() + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.get(mid)[key] <= value else (low, mid)
        return low
