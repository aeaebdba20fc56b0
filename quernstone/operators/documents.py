"""Nested records: JSON paths, child rows, inferred fields, guards and classifications, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by suffix, and suffixes of configuration files.
LANGUAGES = {".go": "go", ".py": "python", ".rs": "rust", ".html": "html", ".htm": "html", ".css": "css"}
CONFIG_SUFFIXES = [".yaml", ".yml", ".json", ".toml"]
#: Calls that delete files, roots of network calls, and plain names of calls that run programs.
DELETES, NETWORK, RUNS = ["remove", "unlink", "rmtree", "rmdir"], ["socket", "requests", "httpx", "urllib"], ["run", "Popen", "call", "check_call", "check_output"]


def at_path(document: Column, path: str) -> Column:
    """The variant at a dotted path; null where there is none."""
    parts = "".join(f"['{p}']" for p in path.split(".") if p)
    return F.try_variant_get(F.try_parse_json(document), f"${parts}", "variant")


def has_path(document: Column, path: str) -> Column:
    return at_path(document, path).isNotNull()


def path_text(document: Column, path: str) -> Column:
    """The value at a path as text: True, False and None for JSON's words and for no value."""
    v = at_path(document, path)
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(F.when(kind != "VOID", text), F.lit("None")))


def matches(document: Column, where: str | None) -> Column:
    """`field=value` without regard to case, `field!=value` with it; nothing asked holds, what cannot be read does not."""
    if not where:
        return F.lit(True)
    if "!=" in where:
        field, value = where.split("!=", 1)
        return path_text(document, field.strip()) != value.strip()
    if "=" not in where:
        return F.lit(False)
    field, value = where.split("=", 1)
    return F.lower(path_text(document, field.strip())) == value.strip().lower()


def children(df: DataFrame, parent: str, items: str, scope: str, names: list[str]) -> DataFrame:
    """(name, parent, idx, item) of the structs in an array; the first of names that is set names an item, else its place."""
    out = df.select(F.col(parent).alias("parent"), F.posexplode(items).alias("pos", "item")).where("item is not null")
    own = [F.nullif(F.col(f"item.{n}").cast("string"), F.lit("")) for n in names]
    return out.select(F.coalesce(*own, F.concat(F.lit(f"{scope}-"), F.col("pos") + 1)).alias("name"), "parent", (F.col("pos") + 1).alias("idx"), "item")


def without_prefix(fields: Column, prefix: str) -> Column:
    """A map without the keys that begin with a reserved prefix."""
    return F.map_filter(fields, lambda k, _: ~k.startswith(prefix))


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """df without the columns that begin with a reserved prefix."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def inferred(path: Column, language: Column, kind: Column, role: Column) -> Column:
    """struct(language, type, role): what a file's path tells where nothing is stated, else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    suffix, low = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)), F.lower(p)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    by_suffix = F.coalesce(*[F.when(suffix == s, v) for s, v in LANGUAGES.items()])
    new_language = F.when(blank(language), by_suffix)
    skill = F.upper(name) == "SKILL.MD"
    prompt = F.concat(F.lit("/"), low).contains("/prompts/")
    new_kind = F.when(blank(kind), F.when(skill, "skill").when(prompt, "prompt").when(suffix.isin(CONFIG_SUFFIXES), "config").when(suffix.isin(list(LANGUAGES)), "code").when(suffix == ".md", "spec"))
    effective = F.coalesce(F.nullif(kind, F.lit("")), new_kind)
    tests = name.endswith("_test.go") | (name.startswith("test_") & (suffix == ".py"))
    new_role = F.when(blank(role), F.when(tests, "verification").when(skill, "orchestration").when(effective == "prompt", "behavior_contract").when(effective == "config", "configuration"))
    known = F.trim(F.coalesce(path, F.lit(""))) != ""
    return F.struct(*[F.when(known, c).alias(n) for n, c in (("language", new_language), ("type", new_kind), ("role", new_role))])


def redundant(explicit: dict[str, Column], inherited: dict[str, Column], skip: list[str]) -> Column:
    """Names of the fields whose stated value is the one that they would inherit."""
    same = [F.when(c.isNotNull() & c.eqNullSafe(inherited[n]), n) for n, c in explicit.items() if n not in skip and n in inherited]
    return F.array_compact(F.array(*same))


def normalized(df: DataFrame, path: str, language: str, kind: str, role: str) -> DataFrame:
    """df with forward slashes in paths and inferred fields filled in."""
    got = inferred(F.col(path), F.col(language), F.col(kind), F.col(role))
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), got[n]) for c, n in ((language, "language"), (kind, "type"), (role, "role"))}
    return df.withColumns({path: F.replace(F.col(path), F.lit("\\"), F.lit("/")), **fill})


def required_number(c: Column, label: str) -> Column:
    """struct(value, error): a finite number, or why it is none."""
    v = c.try_cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.struct(F.when(fine, v).alias("value"), F.when(~F.coalesce(fine, F.lit(False)), F.lit(f"{label} must be a finite numeric value.")).alias("error"))


def required_int(c: Column, label: str, minimum: int | None = None) -> Column:
    """struct(value, error): an integer of at least minimum, or why it is none."""
    text = F.trim(c.cast("string"))
    v = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    low = (v < minimum) if minimum is not None else F.lit(False)
    error = F.when(v.isNull(), F.lit(f"{label} must be an integer.")).when(low, F.lit(f"{label} must be >= {minimum}."))
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def required_text(c: Column, label: str) -> Column:
    """struct(value, error): text that is not blank, trimmed, or why it is none."""
    v = F.nullif(F.trim(c), F.lit(""))
    return F.struct(v.alias("value"), F.when(v.isNull(), F.lit(f"{label} must be a non-empty string.")).alias("error"))


def _number(document: Column, path: str) -> Column:
    v = at_path(document, path)
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))


def _is_object(document: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(at_path(document, path)).startswith("OBJECT"), F.lit(False))


def _first_set(document: Column, *paths: str) -> Column:
    """The number at the first path that is there at all."""
    out = F.lit(None).cast("double")
    for p in reversed(paths):
        out = F.when(has_path(document, p), _number(document, p)).otherwise(out)
    return out


def capacity(document: Column) -> Column:
    """`capacity`, or its `max`, else its `effective`; booleans are no numbers."""
    return F.when(_is_object(document, "capacity"), _first_set(document, "capacity.max", "capacity.effective")).otherwise(_number(document, "capacity"))


def load(document: Column) -> Column:
    return _first_set(document, "load", "baseline_load")


def retry_attempts(document: Column) -> Column:
    """Attempts of `retry` or `retries` (a number, or its `max_attempts`, else `attempts`), else `max_attempts`; whole ones."""
    out = []
    for key in ("retry", "retries"):
        out += [F.when(_is_object(document, key), _first_set(document, f"{key}.max_attempts", f"{key}.attempts")), _number(document, key)]
    return F.floor(F.coalesce(*out, _number(document, "max_attempts"))).cast("long")


def purpose_kind(purpose: Column, path: Column, symbol: Column) -> Column:
    """none, templated (a purpose that holds its own path and symbol) or custom."""
    p = F.trim(F.coalesce(purpose, F.lit("")))
    own = (F.coalesce(path, F.lit("")) != "") & (F.coalesce(symbol, F.lit("")) != "") & p.contains(path) & p.contains(symbol)
    return F.when(p == "", "none").when(F.coalesce(own, F.lit(False)), "templated").otherwise("custom")


def count_by(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) with None for a missing key."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("None")).alias("key")).agg(F.count("*").alias("n"))


def kind_counts(df: DataFrame, kind: Column, kinds: list[str]) -> DataFrame:
    """One row of counts, zero where a kind has no row."""
    return df.agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in kinds])


def capabilities(calls: Column, writes: Column) -> Column:
    """map of four risks from the names of calls; writes tells whether a file is opened to be written."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    first = lambda c: F.element_at(F.split(c, r"\."), 1)
    opens = F.exists(calls, lambda c: (c == "open") | c.endswith(".open"))
    flags = {
        "writes_files": opens & writes, "deletes_files": F.exists(calls, lambda c: last(c).isin(DELETES)),
        "opens_network": F.exists(calls, lambda c: first(c).isin(NETWORK)), "uses_subprocess": F.exists(calls, lambda c: c.startswith("subprocess.") | c.isin(RUNS)),
    }
    return F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])


def timestamp_text(c: Column, *, seconds: bool = False) -> Column:
    """ISO-8601 in UTC, to the microsecond or to the second."""
    form = "yyyy-MM-dd'T'HH:mm:ss" if seconds else "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.concat(F.date_format(c, form), F.lit("+00:00"))


def config_value(document: Column, path: str) -> Column:
    """struct(value, digest) of the value at a dotted path of a configuration, both null where there is none."""
    v = F.try_variant_get(at_path(document, path), "$", "string")
    return F.struct(v.alias("value"), F.sha2(v, 256).alias("digest"))
