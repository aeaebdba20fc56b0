"""Project scans, steps that stop at a blocking finding, scan strategies, adapters, a logical lock and guarded exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quernstone.sources import extract

from .profiles import reusable

#: Extractors by language; meaningful keeps fewer elements of markup.
EXTRACTORS: dict[str, Callable[[str, bool], list[tuple]]] = {
    "python": lambda text, _: extract.python_units(text),
    "go": lambda text, _: extract.go_units(text),
    "rust": lambda text, _: extract.rust_units(text),
    "html": lambda text, meaningful: extract.html_units(text, meaningful=meaningful),
    "css": lambda text, meaningful: extract.css_units(text, meaningful=meaningful),
}


@dataclass(frozen=True)
class Scan:
    """Units of a project's files, and findings of the scan itself."""

    units: DataFrame
    findings: DataFrame


def scan_project(sources: DataFrame, *, meaningful: bool = False, extractors: dict[str, Callable[[str, bool], list[tuple]]] = EXTRACTORS) -> Scan:
    """Units of sources (path, language, text) by language, Python's first, in order of path and place.

    A file that cannot be read (null text) or parsed is a blocking finding; a
    language without an extractor is one finding for information.
    """
    known = sources.where(F.col("language").isin(list(extractors)))
    parts = [extract.units(known.where(F.col("language") == name), "path", "text", lambda t, make=make: make(t, meaningful)).withColumn("language", F.lit(name)) for name, make in extractors.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    broken = rows.where("error and symbol is null").select("path", F.lit("PARSE_ERROR").alias("code"), F.lit("block").alias("severity"))
    broken = broken.unionByName(rows.where("error and symbol is not null").select("path", F.lit("PARSE_ERROR").alias("code"), F.lit("block").alias("severity")).distinct())
    unread = known.where("text is null").select("path", F.lit("READ_ERROR").alias("code"), F.lit("block").alias("severity"))
    other = sources.where(~F.col("language").isin(list(extractors))).select(F.col("language").alias("path"), F.lit("NO_EXTRACTOR").alias("code"), F.lit("info").alias("severity")).distinct()
    return Scan(rows.where("symbol is not null").orderBy("path", "ord"), broken.distinct().unionByName(unread).unionByName(other))


def scan_with_cache(sources: DataFrame, cached: DataFrame, cached_files: DataFrame, signature: list[str], **options) -> DataFrame:
    """Units of files whose signature is as it was, from the cache, and of the others, from a scan."""
    same = reusable(cached_files, sources, "path", signature).select("path")
    fresh = sources.join(same, "path", "left_anti")
    return cached.join(same, "path", "left_semi").unionByName(scan_project(fresh, **options).units)


def strategy(mode: str) -> Callable[..., DataFrame]:
    """How to scan: `full`, or `cached`, which needs the cache as well."""
    if mode == "full":
        return lambda sources, **options: scan_project(sources, **options).units
    if mode == "cached":
        return scan_with_cache
    raise ValueError(f"unknown scan mode {mode}")


def run_steps(steps: Sequence[tuple[str, Callable[[], DataFrame]]], *, stop: tuple[str, ...] = ("block", "critical")) -> list[tuple[str, int, bool]]:
    """(step, findings, stopped) of the steps that ran: each gives findings (severity), and one that must stop ends the run."""
    done = []
    for name, make in steps:
        n, bad = make().agg(F.count("*"), F.count(F.when(F.lower("severity").isin(list(stop)), 1))).first()
        done.append((name, n, bad > 0))
        if bad:
            break
    return done


@dataclass
class Adapters:
    """Sources of catalogue rows by kind; a kind that is registered twice is an error."""

    made: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, kind: str, make: Callable[..., DataFrame]) -> None:
        if kind in self.made:
            raise ValueError(f"{kind} is registered twice")
        self.made[kind] = make

    def open(self, kind: str, *args, **options) -> DataFrame:
        if kind not in self.made:
            raise ValueError(f"no adapter for {kind}")
        return self.made[kind](*args, **options)


class Locked(RuntimeError):
    """A change under a lock that another holds."""


@dataclass
class Lock:
    """A cooperative guard of a store's changes."""

    owner: str | None = None

    def set(self, owner: str, locked: bool) -> None:
        """Take or give back the lock; only its owner may give it back."""
        if self.owner not in (None, owner):
            raise Locked(f"held by {self.owner}")
        self.owner = owner if locked else None

    def check(self, owner: str | None = None) -> None:
        if self.owner not in (None, owner):
            raise Locked(f"held by {self.owner}")


def exported(rows: DataFrame, order: list[str], revision: Callable[[], int], *, batch: int = 200) -> Iterator[list[Row]]:
    """Rows in order, a batch at a time, without a collect; a revision that changes meanwhile is an error."""
    before, held = revision(), []
    for r in rows.orderBy(*order).toLocalIterator():
        held.append(r)
        if len(held) == batch:
            if revision() != before:
                raise RuntimeError("the store has changed during the export")
            yield held
            held = []
    if revision() != before:
        raise RuntimeError("the store has changed during the export")
    if held:
        yield held
