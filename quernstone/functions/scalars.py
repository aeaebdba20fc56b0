"""Scalar column functions: canonical JSON, digests, normal forms, tokens, paths, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of a record, and finding severities.
STATUSES = ["active", "experimental", "legacy", "deprecated"]
SEVERITIES = ["block", "warning", "info"]


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(c))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def short_hash(c: Column, size: int = 16) -> Column:
    """First characters of the digest; null for null or empty text."""
    return F.when(F.length(c) > 0, F.substring(digest(c), 1, size))


def tuple_hash(*cols: Column, size: int = 16) -> Column:
    """Short hash of values joined by a bar; nulls count as empty."""
    return short_hash(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), size)


def stable_uid(kind: Column, identity: Column, ordinal: Column) -> Column:
    """A name-based identifier in the layout of a version 5 UUID over the digest of its parts."""
    h = F.sha1(F.concat_ws(":", kind, identity, ordinal.cast("string")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def escape_like(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def squash(c: Column) -> Column:
    """Lower case, single spaces, trimmed; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(""))


def shard_name(c: Column) -> Column:
    """A file-safe bucket name, `uncategorized` when nothing is left."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s/]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9_-]", ""), r"[_-]{2,}", "_")
    x = F.regexp_replace(x, r"^[_-]+|[_-]+$", "")
    return F.when(x == "", "uncategorized").otherwise(x)


def snake_case(c: Column) -> Column:
    x = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def identifier_tokens(c: Column) -> Column:
    """Lower-case parts of an identifier: humps, acronyms and numbers."""
    x = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(x, F.lit(r"([A-Za-z]+|[0-9]+)"), 1), F.lower)


def plain_tokens(c: Column) -> Column:
    """Lower-case alphanumeric runs, humps apart."""
    x = F.regexp_replace(F.regexp_replace(c, r"[.\-]", " "), r"([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+)"), 1)


def sentence_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9]*)"), 1)


def first_sentence(c: Column) -> Column:
    """Text before the first sentence end, its own mark off."""
    return F.regexp_replace(F.trim(F.element_at(F.split(F.trim(c), r"(?<=[.!?])\s+", 2), 1)), r"[.!?]+$", "")


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Runs of n neighbouring tokens."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), sep))).otherwise(F.array().cast("array<string>"))


def alias_of(c: Column, table: dict[str, str]) -> Column:
    """The table's value for c, else c itself."""
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c


def qualifiers(c: Column) -> Column:
    """Prepositional phrases up to the next punctuation."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\b((?:to|from|for|with|in|on) [^.,;:]+)"), 1)


def last_part(c: Column, sep: str = r"\.") -> Column:
    return F.element_at(F.split(c, sep), -1)


def parent_part(c: Column, sep: str = r"\.") -> Column:
    return F.try_element_at(F.split(c, sep), F.lit(-2))


def is_absolute_path(c: Column) -> Column:
    return c.rlike(r"^(/|[A-Za-z]:[\\/])")


def looks_like_path(c: Column) -> Column:
    return c.rlike(r"^[\w.\-]+(/[\w.\-]+)+$")


def looks_like_endpoint(c: Column) -> Column:
    return c.rlike(r"^/[\w\-{}<>:./]*$")


def looks_like_sql(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(r"^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|MERGE)\b")


def sql_effect(c: Column) -> Column:
    """struct(verb, target) of an SQL text."""
    x = squash(c)
    return F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("verb"), F.regexp_extract(x, r"\b(?:into|from|update|table)\s+([\w.]+)", 1).alias("target"))


def parse_value(c: Column) -> Column:
    """JSON of a literal: JSON as it is, true/false/null words, anything else as a JSON string."""
    low = F.lower(F.trim(c))
    word = F.when(low.isin("true", "false"), low).when(low.isin("null", "none"), F.lit("null"))
    return F.coalesce(canonical_json(c), word, F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted keys, not reserved by a leading $, whose values differ between two maps."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(keys, lambda k: ~k.startswith("$") & ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def field_level_change(old: Column, new: Column, identity: list[str]) -> Column:
    """struct(before, after, absent): only identity and changed fields of two maps."""
    changed = changed_keys(old, new)
    some = lambda k: F.array_contains(F.array_union(changed, F.array(*map(F.lit, identity))), k)
    return F.struct(
        F.map_filter(old, lambda k, v: some(k)).alias("before"), F.map_filter(new, lambda k, v: some(k)).alias("after"),
        F.filter(changed, lambda k: ~F.array_contains(F.map_keys(new), k)).alias("absent"),
    )


def redacted(m: Column, secret: str = r"(?i)(password|passwd|secret|token|api_?key|credential)") -> Column:
    """Map with values under secret-like keys replaced by a mark and their hash."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(secret), F.concat(F.lit("redacted:"), digest(v))).otherwise(v))


def template_variables(c: Column) -> Column:
    """Sorted distinct names in {{x}} and ${x}."""
    names = F.concat(F.regexp_extract_all(c, F.lit(r"\{\{\s*([\w.]+)\s*\}\}"), 1), F.regexp_extract_all(c, F.lit(r"\$\{([\w.]+)\}"), 1))
    return F.array_sort(F.array_distinct(names))


def under_path(c: Column, ignored: list[str]) -> Column:
    """Whether any component of a path is among the ignored names."""
    return F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, ignored)))


def moved_path(c: Column, old: str, new: str) -> Column:
    """Path with its prefix old, as a whole component, replaced by new."""
    return F.when(c == old, F.lit(new)).when(c.startswith(old + "/"), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c)


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy/MM")


def spreadsheet_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def first_case(*cases: tuple[Column, str], default: str | None = None) -> Column:
    """The value of the first case that holds."""
    out = reduce(lambda w, x: w.when(x[0], F.lit(x[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1])))
    return out if default is None else out.otherwise(F.lit(default))


def rank_confidence(c: Column) -> Column:
    """low 0, medium 1, high 2, anything else -1."""
    return F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2).otherwise(-1)
