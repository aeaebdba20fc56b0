"""Sources and sinks: source trees, JSON journals, patch tables, in-memory rows, exports."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalars import spreadsheet_safe, under_path
from quernstone.operators import publish
from quernstone.operators.publish import Journal

#: Languages by file suffix, and directories that a scan leaves out.
LANGUAGES = {"py": "python", "go": "go", "rs": "rust", "html": "html", "htm": "html", "css": "css"}
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "build", "dist"]


def registry(spark: SparkSession, definitions: Iterable[tuple[str, str]] = tuple(LANGUAGES.items())) -> DataFrame:
    """(suffix, language); a suffix that is registered twice is an error."""
    rows = list(definitions)
    if len({s for s, _ in rows}) != len(rows):
        raise ValueError("a suffix is registered twice")
    return spark.createDataFrame(rows, "suffix string, language string")


def source_tree(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, language, length, modified, digest) of the supported files under root, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    rows = files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))
    rows = rows.where(~under_path(F.col("path"), ignored)).withColumn("suffix", F.lower(F.element_at(F.split("path", r"\."), -1)))
    return rows.join(F.broadcast(registry(spark)), "suffix").select("path", "language", "length", "modified", "digest").orderBy("path")


def stale_files(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Files to scan again: not cached with the same length and time."""
    return now.join(cached.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a JSON journal with their numbers; broken lines are marked, blank ones dropped."""
    rows = spark.read.text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    # numbers: a line's place in its partition, and the lines of the partitions before; of a file, Spark's splits are in order
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy(F.col("a.p").alias("p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    raw = rows.join(F.broadcast(before), part == F.col("p")).select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("line"), "text").where(F.trim("text") != "")
    parsed = F.from_json("text", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.select("line", parsed.alias("j")).select("line", "j.*").withColumn("corrupt", F.col("_bad").isNotNull()).drop("_bad")


def history(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events of JSON files, plain or gzip, from all folders below."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


def patches(spark: SparkSession, path: str) -> DataFrame:
    """Edits (uid, seq, expected_revision, op, field, value) of a CSV patch; values are JSON or plain text."""
    rows = spark.read.option("header", True).schema("uid string, revision long, field string, op string, value string").csv(path)
    value = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "string"), F.col("value"))
    return rows.select("uid", F.monotonically_increasing_id().alias("seq"), F.col("revision").alias("expected_revision"), "op", "field", value.alias("value"))


def from_rows(spark: SparkSession, rows: Iterable[dict], key: str) -> DataFrame:
    """A dataset of dicts: its columns are the union of keys, its key must be unique."""
    rows = list(rows)
    columns = sorted({k for r in rows for k in r})
    if len({r.get(key) for r in rows}) != len(rows):
        raise ValueError("the key is not unique")
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], columns)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells are safe to open in a spreadsheet; never over an existing folder."""
    text = {c for c, t in df.dtypes if t == "string"}
    df.select(*[spreadsheet_safe(F.col(c)).alias(c) if c in text else c for c in df.columns]).write.mode("errorifexists").option("header", True).csv(path)


def export_events(df: DataFrame, path: str) -> None:
    """Gzip JSON by year and month of ts."""
    df.withColumn("year", F.year("ts")).withColumn("month", F.month("ts")).write.mode("append").partitionBy("year", "month").option("compression", "gzip").json(path)


def export_shards(df: DataFrame, path: str, shard: str) -> None:
    df.write.mode("errorifexists").partitionBy(shard).parquet(path)


def is_watched(path: Column, suffixes: list[str], ignored: list[str], cache: str = ".cache") -> Column:
    """Whether a change of a project's file matters: not under an ignored folder or the cache, with a suffix that is read."""
    parts = F.split(path, "/")
    suffix = F.lit(False)
    for x in suffixes:
        suffix = suffix | path.endswith(x)
    return suffix & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored))) & ~path.startswith(f"{cache}/") & ~path.startswith("/")


def source_roots(names: list[str], languages: list[str], *, folders: list[str]) -> list[str]:
    """Roots to scan, from the names of files and folders at the top: all of a project with a manifest of its own, else the common folders that are there, else all if a file can be read, else src and app."""
    if {"go.mod", "Cargo.toml"} & set(names):
        return ["."]
    common = [n for n in COMMON_ROOTS if n in folders]
    if common:
        return common
    return ["."] if any(n.endswith(tuple(languages)) for n in names) else ["src", "app"]


#: Folders that commonly hold sources, in order.
COMMON_ROOTS = ["src", "app", "lib", "core", "cmd", "internal", "pkg", "web", "static"]


def export_json(rows: DataFrame, path: str, *, key: str) -> None:
    """One canonical JSON object a line, in order of key; an existing export is an error."""
    rows.orderBy(key).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def append_journal(rows: DataFrame, path: str) -> None:
    """Add rows to a journal of JSON lines, as files of their own, so that a broken last line of another stays apart."""
    rows.write.mode("append").json(path)


def backup(spark: SparkSession, source: str, target: str, *, form: str = "parquet") -> None:
    """A copy of a table at a new place alone."""
    spark.read.format(form).load(source).write.mode("errorifexists").format(form).save(target)


def replace_table(rows: DataFrame, path: str) -> None:
    """Make rows the table at path: written as a version beside the others, which an entry of its journal then names at once.

    A crash leaves the old version or the new one, and of two writers one is
    refused. The version before the last stays for its readers; older ones go.
    """
    spark, journal = rows.sparkSession, Journal(rows.sparkSession, f"{path}/journal")
    last, name = journal.last(), uuid4().hex
    rows.write.parquet(f"{path}/versions/{name}")
    before = journal.get(last)["version"] if last else None
    journal.append(last + 1, {"version": name, "before": before})
    for old in publish.children(spark, f"{path}/versions"):
        if old not in (name, before):
            publish.remove(spark, f"{path}/versions/{old}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace_table() has last published at path."""
    journal = Journal(spark, f"{path}/journal")
    last = journal.last()
    if not last:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/versions/{journal.get(last)['version']}")


def sharded(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of listed JSON shards with the shard that each comes from."""
    return spark.read.schema(schema).json(paths).withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def document_state(found: bool, n_blocks: int, n_drafts: int, valid: bool = True) -> str:
    """State of a document: missing, invalid, empty, draft while a block is one, else defined."""
    if not found:
        return "missing"
    if not valid:
        return "invalid"
    return "empty" if not n_blocks else "draft" if n_drafts else "defined"


def flow_references(sources: DataFrame, files: DataFrame, bound: DataFrame, suffixes: list[str]) -> DataFrame:
    """(path, referenced_by): files of a flow that sources (path, text) embed or quote, that are there and that nothing binds; of several sources the last counts."""
    embedded = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^//go:embed +(.+)$"), F.lit(1)), lambda x: F.filter(F.split(x, " +"), lambda p: ~p.rlike(r"[*?\[\]]"))))
    quoted = F.regexp_extract_all("text", F.lit("\"([^\"\n]+\\.[a-z]+)\""), F.lit(1))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    refs = sources.select(F.col("path").alias("referenced_by"), folder.alias("folder"), F.explode(F.concat(embedded, quoted)).alias("raw"))
    refs = refs.withColumn("target", F.concat("folder", F.regexp_replace("raw", r"^\./", "")))
    right = F.lit(False)
    for x in suffixes:
        right = right | F.lower("target").endswith(x)
    refs = refs.where(right).join(files.select(F.col("path").alias("fp")).distinct(), F.col("target") == F.col("fp"), "left_semi").join(bound.select(F.col("path").alias("bp")).distinct(), F.col("target") == F.col("bp"), "left_anti")
    return refs.groupBy(F.col("target").alias("path")).agg(F.max("referenced_by").alias("referenced_by"))
