"""Queries of nested records, inferred fields, guards, secrets and text regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import documents as d
from quernstone.operators import regions, security

from .registry import query, table

#: JSON texts made from events: nested, with booleans and missing fields, the same in Spark and in SQL.
_DOC = "'{\"k\":' || event_id % 7 || ',\"on\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',\"kind\":{\"name\":\"' || upper(event_type) || '\"' || CASE WHEN event_id % 3 = 0 THEN ',\"max\":' || event_id % 11 ELSE '' END || '}}'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("doc", F.expr(_DOC))


@query("""
    SELECT event_id, event_type IN ('click', 'Click') AS equal_name, event_id % 2 = 0 AS equal_flag, upper(event_type) <> 'click' AS other_name, event_id % 3 <> 0 AS no_max, TRUE AS other_missing
    FROM events
""")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    rules = {"equal_name": "kind.name=Click", "equal_flag": "on = TRUE", "other_name": "kind.name!=click", "no_max": "kind.max=none", "other_missing": "gone!=none"}
    return _events(spark, sf_dir).select("event_id", *[d.matches(doc, w).alias(n) for n, w in rules.items()])


@query("SELECT event_id, event_id % 3 = 0 AS has_max, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 11 AS VARCHAR) END AS max, CASE WHEN event_id % 3 = 0 THEN sha256(CAST(event_id % 11 AS VARCHAR)) END AS digest FROM events")
def config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = d.config_value(F.col("doc"), "kind.max")
    return _events(spark, sf_dir).select("event_id", d.has_path(F.col("doc"), "kind.max").alias("has_max"), got.value.alias("max"), got.digest.alias("digest"))


@query("""
    SELECT coalesce(nullif(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_partkey ELSE '' END, ''), 'item-' || row_number() OVER w) AS name, l_orderkey AS parent, CAST(row_number() OVER w AS INTEGER) AS idx, l_quantity AS quantity
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity)
""")
def scope_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).otherwise("").alias("id"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(item)).alias("items"))
    return d.children(orders, "l_orderkey", "items", "item", ["id"]).select("name", "parent", "idx", F.col("item.l_quantity").alias("quantity"))


@query("SELECT p_partkey, p_name, array_to_string(list_sort(['name', 'size']), ',') AS keys FROM part")
def reserved_fields_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("__x"), F.col("p_type")).alias("fields"), F.col("p_brand").alias("__brand"))
    kept = d.drop_prefix(part, "__").withColumn("fields", d.without_prefix(F.col("fields"), "__"))
    return kept.select("p_partkey", "p_name", F.array_join(F.sort_array(F.map_keys("fields")), ",").alias("keys"))


_FILES = "CASE p_partkey % 9 WHEN 0 THEN 'src\\m' || p_partkey || '.py' WHEN 1 THEN 'a/test_' || p_partkey || '.py' WHEN 2 THEN 'prompts/p.md' WHEN 3 THEN 'x/Skill.md' WHEN 4 THEN 'conf/' || p_partkey || '.TOML' WHEN 5 THEN 'web/i.html' WHEN 6 THEN 'n_test.go' WHEN 7 THEN 'notes.md' ELSE '' END"


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("p_size") % 2 == 0, "given").otherwise(F.lit(None))
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILES.replace("\\", "\\\\")).alias("path"), blank.alias("language"), blank.alias("type"), F.lit("").alias("role"))


_INFERRED = f"""
    a AS (SELECT p_partkey, replace({_FILES}, '\\', '/') AS path, CASE WHEN p_size % 2 = 0 THEN 'given' END AS given, p_partkey % 9 AS k FROM part),
    i AS (SELECT *, CASE WHEN given IS NULL THEN CASE WHEN k IN (0, 1) THEN 'python' WHEN k = 5 THEN 'html' WHEN k = 6 THEN 'go' END END AS language,
                 CASE WHEN given IS NULL THEN CASE k WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'prompt' WHEN 3 THEN 'skill' WHEN 4 THEN 'config' WHEN 5 THEN 'code' WHEN 6 THEN 'code' WHEN 7 THEN 'spec' END END AS type,
                 CASE WHEN k IN (1, 6) THEN 'verification' WHEN k = 3 THEN 'orchestration' WHEN k = 2 AND given IS NULL THEN 'behavior_contract' WHEN k = 4 AND given IS NULL THEN 'configuration' END AS role FROM a)
"""


@query(f"WITH {_INFERRED} SELECT p_partkey, language, type, role FROM i")
def metadata_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _artifacts(spark, sf_dir)
    return a.select("p_partkey", d.inferred(F.col("path"), F.col("language"), F.col("type"), F.col("role")).alias("i")).select("p_partkey", "i.*")


@query(f"WITH {_INFERRED} SELECT p_partkey, path, coalesce(given, language) AS language, coalesce(given, type) AS type, role FROM i")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.normalized(_artifacts(spark, sf_dir), "path", "language", "type", "role")


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 25 THEN 'size' END, CASE WHEN p_type = 'ECONOMY' THEN 'type' END) AS fields FROM part")
def redundant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = {"size": F.greatest("p_size", F.lit(25)), "type": F.col("p_type"), "id": F.col("p_partkey")}
    inherited = {"size": F.greatest(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0), F.lit(0)), "type": F.lit("ECONOMY"), "id": F.col("p_partkey")}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(d.redundant(explicit, inherited, ["id"]), ",").alias("fields"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS number, CASE WHEN c_custkey % 3 <> 0 THEN 'margin must be a finite numeric value.' END AS number_error,
           CASE WHEN c_custkey % 4 <> 1 AND c_nationkey >= 5 THEN CAST(c_nationkey AS BIGINT) END AS whole,
           CASE WHEN c_custkey % 4 = 1 THEN 'max must be an integer.' WHEN c_nationkey < 5 THEN 'max must be >= 5.' END AS whole_error,
           CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS text, CASE WHEN c_custkey % 5 = 0 THEN 'field must be a non-empty string.' END AS text_error
    FROM customer
""")
def value_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).when(k % 3 == 1, "NaN").otherwise("many")
    whole = F.when(k % 4 == 1, F.lit("2.5")).otherwise(F.col("c_nationkey").cast("string"))
    text = F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    a, b, c = d.required_number(number, "margin"), d.required_int(whole, "max", 5), d.required_text(text, "field")
    return table(spark, sf_dir, "customer").select("c_custkey", a.value.alias("number"), a.error.alias("number_error"), b.value.alias("whole"), b.error.alias("whole_error"), c.value.alias("text"), c.error.alias("text_error"))


_PROPS = "CASE event_id % 6 WHEN 0 THEN '{\"capacity\":{\"max\":9,\"effective\":3},\"load\":1.5}' WHEN 1 THEN '{\"capacity\":{\"effective\":4},\"baseline_load\":2,\"retry\":{\"attempts\":3}}' WHEN 2 THEN '{\"capacity\":true,\"retries\":5}' WHEN 3 THEN '{\"capacity\":7,\"load\":\"x\",\"baseline_load\":1,\"max_attempts\":2}' WHEN 4 THEN '{\"retry\":{\"max_attempts\":4,\"attempts\":1}}' ELSE '{}' END"


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 9.0 WHEN 1 THEN 4.0 WHEN 3 THEN 7.0 END::DOUBLE AS capacity, CASE event_id % 6 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 END::DOUBLE AS load,
           CASE event_id % 6 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 4 END::BIGINT AS attempts FROM events
""")
def capacity_and_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_PROPS).alias("p"))
    return e.select("event_id", d.capacity(F.col("p")).alias("capacity"), d.load(F.col("p")).alias("load"), d.retry_attempts(F.col("p")).alias("attempts"))


_PURPOSE = "CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'Handles ' || p_brand || ' in ' || p_type WHEN 2 THEN 'Sells ' || p_name END"


@query(f"WITH k AS (SELECT CASE p_partkey % 4 WHEN 1 THEN 'templated' WHEN 2 THEN 'custom' ELSE 'none' END AS kind, p_size FROM part) SELECT count(*) FILTER (WHERE kind = 'none') AS none, count(*) FILTER (WHERE kind = 'templated') AS templated, count(*) FILTER (WHERE kind = 'custom') AS custom, count(*) FILTER (WHERE kind = 'gone') AS gone FROM k")
def purpose_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = d.purpose_kind(F.expr(_PURPOSE), F.col("p_brand"), F.col("p_type"))
    return d.kind_counts(table(spark, sf_dir, "part"), kind, ["none", "templated", "custom", "gone"])


@query("SELECT coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END, 'None') AS key, count(*) AS n FROM customer GROUP BY 1")
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.count_by(table(spark, sf_dir, "customer"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")))


@query("""
    SELECT event_id, event_id % 5 IN (0, 4) AS writes_files, event_id % 5 = 1 AS deletes_files, event_id % 5 = 2 AS opens_network, event_id % 5 = 3 AS uses_subprocess FROM events
""")
def capability_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["open", "os.remove", "requests.get", "subprocess.run", "Path.open"]))
    calls = F.array(F.lit("print"), F.get(names, (F.col("event_id") % 5).cast("int")))
    flags = d.capabilities(calls, F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", *[flags[k].alias(k) for k in ("writes_files", "deletes_files", "opens_network", "uses_subprocess")])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS seconds FROM events")
def timestamps_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", d.timestamp_text(F.col("ts")).alias("stamp"), d.timestamp_text(F.col("ts"), seconds=True).alias("seconds"))


# secrets

_WORDS_SQL = r"(regexp_matches(lower(value), '\b(?:password|passwd|secret|token|credential|credentials|bearer|jwt)\b') OR regexp_matches(lower(value), 'api_key|apikey|private_key|database_url|connection_string|access_key|refresh_token|client_secret'))"
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MATERIAL_SQL = " OR ".join(["regexp_matches(value, " + _quoted(f"(?i){shape}") + ")" for _, shape in security.SHAPES])
_PLAIN_SQL = "value"
for _pattern, _to in security.PLAINER:
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, {_quoted(_pattern)}, {_quoted(_to)}, 'g')"
_ASSIGNED_SQL = f"regexp_matches({_PLAIN_SQL}, {_quoted(security.ASSIGNED)})"


@query(f"SELECT doc_id FROM (SELECT doc_id, text AS value FROM documents) WHERE {_MATERIAL_SQL} OR {_ASSIGNED_SQL}")
def credential_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(security.has_material(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, text AS value FROM documents) WHERE {_WORDS_SQL}")
def secret_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(security.has_secret_word(F.col("text"))).select("doc_id")


_LEAF = "CASE event_id % 8 WHEN 0 THEN 'a password field' WHEN 1 THEN 'token: x' || event_id WHEN 2 THEN '/v1/items?x=' || event_id WHEN 3 THEN '/etc/hosts' WHEN 4 THEN '/a/../b' WHEN 5 THEN 'C:\\x' WHEN 6 THEN 'secret = {{vault.key}}' ELSE 'plain' END"
_PATH = "'root.' || CASE event_id % 3 WHEN 0 THEN 'blocks[' || event_id % 9 || '].purpose' WHEN 1 THEN 'blocks[1].interface.inputs[0].default' ELSE 'notes' END"


@query(r"""
    WITH e AS (SELECT event_id, event_id % 8 AS v, event_id % 3 AS p FROM events)
    SELECT event_id, 'absolute_path' AS code FROM e WHERE v IN (3, 4, 5) OR v = 2 AND p <> 1
    UNION ALL SELECT event_id, 'secret_value' FROM e WHERE v = 1 OR v IN (0, 6) AND p <> 0
""")
def leaf_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "events").select("event_id", F.expr(_PATH).alias("path"), F.expr(_LEAF.replace("\\", "\\\\")).alias("value"))
    return security.leaf_findings(leaves, "path", "value", root="root").select("event_id", "code")


@query(f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT doc_id, 'document.page.parts[0].lines[' || i || ']' AS path, value, 'secret_value' AS code FROM l WHERE {_WORDS_SQL} OR {_MATERIAL_SQL} OR {_ASSIGNED_SQL}
    UNION ALL SELECT doc_id, 'document.page.parts[0].lines[' || i || ']', value, 'absolute_path' FROM l WHERE regexp_matches(trim(value), '^(/|\\\\[\\\\/]|.:[\\\\/])')
    UNION ALL SELECT doc_id, 'document.page.api_key', 'n' || doc_id, 'secret_field' FROM documents
""")
def nested_secret_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.struct(F.split("text", "\n").alias("lines"))
    page = F.struct("source", F.array(lines).alias("parts"), F.concat(F.lit("n"), "doc_id").alias("api_key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(page.alias("page"))).alias("doc"))
    return security.scan_documents(docs, "doc_id", "doc")


# regions of texts

_TEXT = "'# Top' || chr(10) || 'a' || c_custkey || chr(10) || '## Sub ' || c_custkey % 3 || chr(10) || 'b' || chr(10) || '<!-- begin x -->' || chr(10) || 'r1' || chr(10) || 'r2' || chr(10) || '<!-- end x -->' || chr(10) || '# Next' || chr(10) || 'c'"


@query("SELECT c_custkey, '## Sub 1' || chr(10) || 'b' || chr(10) || '<!-- begin x -->' || chr(10) || 'r1' || chr(10) || 'r2' || chr(10) || '<!-- end x -->' AS section FROM customer WHERE c_custkey % 3 = 1")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    return regions.sections(regions.lines(texts, "c_custkey", "text"), "c_custkey", "SUB 1")


@query("SELECT c_custkey, 'r1' || chr(10) || 'r2' AS region FROM customer")
def marked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    return regions.marked(regions.lines(texts, "c_custkey", "text"), "c_custkey", "begin x", "end x")
