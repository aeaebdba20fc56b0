"""Catalogue queries: filter, search, facets, keyset and offset pages, relations, selections."""

from __future__ import annotations

import string
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

PAGE_LIMIT, SELECTION_LIMIT, SEARCH_LIMIT = 100, 10_000, 512


class StaleCursor(ValueError):
    """A cursor of another query or another revision."""


@dataclass(frozen=True)
class Query:
    """What to read from a catalogue: equality filters, a text, and an order."""

    filters: Mapping[str, object] = field(default_factory=dict)
    search: str = ""
    sort: str = "uid"
    descending: bool = False
    limit: int = 30

    def fingerprint(self) -> str:
        return sha256(repr((sorted(self.filters.items()), self.search, self.sort, self.descending)).encode()).hexdigest()[:20]


@dataclass(frozen=True)
class Cursor:
    key: object
    uid: object
    fingerprint: str
    revision: int


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    has_next: bool
    has_previous: bool
    first: Cursor | None
    last: Cursor | None


def matches(df: DataFrame, filters: Mapping[str, object], allowed: list[str]) -> Column:
    """All equalities; a field outside the allowed ones is an error."""
    if bad := set(filters) - set(allowed):
        raise ValueError(f"fields not allowed: {sorted(bad)}")
    return reduce(lambda a, b: a & b, [F.col(f) == F.lit(v).cast(df.schema[f].dataType) for f, v in filters.items()], F.lit(True))


def contains_text(text: str, columns: list[str]) -> Column:
    """Substring without regard to ASCII case in any column; null columns don't match."""
    if len(text) > SEARCH_LIMIT:
        raise ValueError("search text is too long")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    wanted = text.translate(str.maketrans(upper, lower))
    found = [F.coalesce(F.instr(F.translate(F.col(c).cast("string"), upper, lower), wanted) > 0, F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found) if text else F.lit(True)


def anywhere(text: str, columns: list[str]) -> Column:
    """Substring of all values joined by a space."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(text.lower())


def select(df: DataFrame, query: Query, *, filterable: list[str], searchable: list[str]) -> DataFrame:
    return df.where(matches(df, query.filters, filterable) & contains_text(query.search, searchable))


def keyset(df: DataFrame, sort: str, uid: str, *, descending: bool = False, after: tuple | None = None, before: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Rows in order of (sort, uid), from beyond a position; backward pages come nearest first."""
    key = F.coalesce(F.col(sort).cast("string"), F.lit("")) if dict(df.dtypes)[sort] == "string" else F.col(sort)
    place = F.struct(key.alias("k"), F.col(uid).alias("u"))
    at = lambda p: F.struct(F.lit(p[0]).cast(df.select(key).dtypes[0][1]).alias("k"), F.lit(p[1]).cast(dict(df.dtypes)[uid]).alias("u"))
    down = descending
    if after is not None:
        df = df.where(place < at(after) if descending else place > at(after))
    if before is not None:
        df = df.where(place > at(before) if descending else place < at(before))
        down = not descending
    order = [key.desc(), F.col(uid).desc()] if down else [key.asc(), F.col(uid).asc()]
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def page(df: DataFrame, query: Query, *, uid: str, revision: int, filterable: list[str], searchable: list[str], after: Cursor | None = None, before: Cursor | None = None) -> Page:
    """One page with cursors that hold for this query and revision only."""
    if not 1 <= query.limit <= PAGE_LIMIT:
        raise ValueError("limit out of range")
    if query.sort not in df.columns:
        raise ValueError(f"cannot sort by {query.sort}")
    for c in (after, before):
        if c is not None and (c.fingerprint, c.revision) != (query.fingerprint(), revision):
            raise StaleCursor("the cursor belongs to another query or revision")
    place = lambda c: None if c is None else (c.key, c.uid)
    rows = keyset(select(df, query, filterable=filterable, searchable=searchable), query.sort, uid, descending=query.descending, after=place(after), before=place(before), limit=query.limit + 1).collect()
    more, rows = len(rows) > query.limit, rows[: query.limit]
    if before is not None:
        rows.reverse()
    mark = lambda r: Cursor(r[query.sort] if r[query.sort] is not None else "", r[uid], query.fingerprint(), revision)
    ends = (mark(rows[0]), mark(rows[-1])) if rows else (None, None)
    return Page(rows, more if before is None else bool(rows), (after is not None) if before is None else more, *ends)


def offset_page(df: DataFrame, order: list[Column], position: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(position).limit(limit)


def mixed_order(column: str, uid: str, *, descending: bool = False) -> list[Column]:
    """Numbers before other text, nulls last; the reverse turns everything round."""
    c = F.col(column).cast("string")
    number = c.try_cast("double")
    keys = [c.isNull(), number.isNull(), F.coalesce(number, F.lit(0.0)), F.coalesce(c, F.lit("")), F.col(uid)]
    return [k.desc() if descending else k.asc() for k in keys]


def facets(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, most frequent first; null is a value of its own."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(column))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the given values only, zero where there are none."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def incoming(edges: DataFrame, nodes: DataFrame, target: object, limit: int, *, source: str = "source", key: str = "uid") -> DataFrame:
    """Nodes with an edge to target, in order of the source; one more than the limit shows that there are more."""
    hits = edges.where(F.col("target") == F.lit(target)).select(F.col(source).alias("_s"))
    return nodes.join(hits, F.col(key) == F.col("_s")).drop("_s").orderBy(key).limit(limit + 1)


def resolve(refs: DataFrame, nodes: DataFrame, literal: str, uid: str, external: str) -> DataFrame:
    """Refs with `resolved`: the node whose uid is the literal, else one whose external id is (the least uid)."""
    by_uid = nodes.select(F.col(uid).cast("string").alias("_u")).distinct()
    by_ext = nodes.groupBy(F.col(external).cast("string").alias("_e")).agg(F.min(F.col(uid).cast("string")).alias("_x"))
    out = refs.join(by_uid, F.col(literal).cast("string") == F.col("_u"), "left").join(by_ext, F.col(literal).cast("string") == F.col("_e"), "left")
    return out.withColumn("resolved", F.coalesce("_u", "_x")).drop("_u", "_e", "_x")


def bounded(df: DataFrame, most: int | None = SELECTION_LIMIT) -> DataFrame:
    """df, or an error if it has more rows than a selection that a caller holds may have; with most=None all of it, for a caller that reads it as a table."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows match")
    return df


def selection(spec: str, size: int) -> list[int]:
    """Indexes of a spec such as `1,3,5-8` or `all`, without repeats, in order."""
    out: list[int] = []
    for part in spec.replace(" ", "").split(","):
        if part == "all":
            out += range(size)
        elif part:
            a, _, b = part.partition("-")
            lo, hi = int(a), int(b or a)
            if not 1 <= lo <= hi <= size:
                raise ValueError(f"out of range: {part}")
            out += range(lo - 1, hi)
    return list(dict.fromkeys(out))
