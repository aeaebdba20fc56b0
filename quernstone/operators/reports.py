"""Reports that are kept under a digest of all that they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from . import publish


def file_signature(spark: SparkSession, path: str) -> list[list]:
    """(name, size, time of change) of every file below a path, from the file system's listing; no job runs."""
    at, fs = publish._at(spark, path)
    if not fs.exists(at):
        return []
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def digest_of(versions: dict[str, object], signatures: list) -> str:
    """The key of a report: the digest of the analyzers' versions and states, and of the inputs' signatures."""
    return hashlib.sha256(json.dumps([versions, signatures], sort_keys=True, default=str).encode()).hexdigest()


class ReportCache:
    """Reports by key, in a folder whose journal names the last `keep` of them.

    A report is written beside the others and counts once the journal names it; of
    two writers of one key the first one's stands. What is no longer named goes.
    """

    def __init__(self, spark: SparkSession, folder: str, *, keep: int = 32) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self.journal = publish.Journal(spark, f"{self.folder}/journal")

    def _named(self) -> tuple[int, list[dict]]:
        last = self.journal.last()
        return last, self.journal.get(last)["reports"] if last else []

    def get(self, key: str) -> DataFrame | None:
        """A report, of which not even a schema is read from files; null if none is kept."""
        for r in self._named()[1]:
            if r["key"] == key:
                return self.spark.read.schema(r["schema"]).parquet(f"{self.folder}/{r['place']}")
        return None

    def put(self, key: str, report: DataFrame) -> DataFrame:
        place = f"reports/{uuid4().hex}"
        report.write.parquet(f"{self.folder}/{place}")
        while True:
            last, reports = self._named()
            if any(r["key"] == key for r in reports):
                publish.remove(self.spark, f"{self.folder}/{place}")
                break
            entry = {"key": key, "place": place, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.schema)}
            kept = [*reports, entry][-self.keep:]
            try:
                self.journal.append(last + 1, {"reports": kept})
            except publish.Conflict:
                continue
            for r in reports:
                if r not in kept:
                    publish.remove(self.spark, f"{self.folder}/{r['place']}")
            break
        return self.get(key)

    def report(self, versions: dict[str, object], inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
        """make()'s report, made only if a version, a state or a file of the inputs is not what it was made from."""
        key = digest_of(versions, [file_signature(self.spark, p) for p in inputs])
        found = self.get(key)
        return self.put(key, make()) if found is None else found
