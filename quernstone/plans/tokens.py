"""Queries of identifiers, phrases, predicates and aggregates whose results are known by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scalars as s
from quernstone.operators import documents as d
from quernstone.operators import suggestions as sg
from quernstone.sources import extract, files

from .registry import query, table

def _key() -> Column:
    return F.col("p_partkey")


def _size() -> Column:
    return F.col("p_size")


def _brand() -> Column:
    return F.col("p_brand")


def _text(*parts: object) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""
    SELECT p_partkey, 'parse,http,request,' || p_size AS identifier, 'load,big,file,' || p_size || ',v2' AS plain, 'get_item_x' || p_size AS snake, 'a_b,b_' || p_size AS pairs, 'r' || p_size AS last, 'mid' AS parent, CASE WHEN p_size % 2 = 0 THEN 'search' ELSE 'find' || p_size END AS alias
    FROM part
""")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = _text("top.mid.r", _size())
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(s.identifier_tokens(_text("parseHTTPRequest", _size())), ",").alias("identifier"), F.array_join(s.plain_tokens(_text("loadBig.file-", _size(), " V2")), ",").alias("plain"),
        s.snake_case(_text(" getItem-X", _size(), "!")).alias("snake"), F.array_join(s.ngrams(F.array(F.lit("a"), F.lit("b"), _size().cast("string")), 2, "_"), ",").alias("pairs"),
        s.last_part(dotted).alias("last"), s.parent_part(dotted).alias("parent"), s.alias_of(F.when(_size() % 2 == 0, "find").otherwise(_text("find", _size())), {"find": "search"}).alias("alias"),
    )


@query("""
    SELECT p_partkey, 'Finds ' || p_name || ' fast' AS sentence, 'from ' || lower(p_brand) || '|with care' AS phrases, 'b,' || 'x' || p_size AS variables, 'a\\%b\\_' || p_size AS pattern FROM part
""")
def phrase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", s.first_sentence(_text("  Finds ", F.col("p_name"), " fast.  Then stops! No.")).alias("sentence"),
        F.array_join(s.qualifiers(_text("Takes it from ", _brand(), ", with care; ok")), "|").alias("phrases"),
        F.array_join(s.template_variables(_text("${x", _size(), "} {{ b }} {{b}}")), ",").alias("variables"), s.escape_like(_text("a%b_", _size())).alias("pattern"),
    )


@query("""
    SELECT p_partkey, p_partkey % 5 = 0 AS is_path, p_partkey % 5 = 1 AS is_endpoint, p_partkey % 5 = 2 AS is_sql, p_partkey % 5 = 1 OR p_partkey % 5 = 4 AS is_absolute, p_partkey % 5 = 0 AS is_ignored,
           CASE p_partkey % 5 WHEN 2 THEN 'update' END AS verb, CASE p_partkey % 5 WHEN 2 THEN 't' || p_size END AS target FROM part
""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(_key() % 5 == 0, _text("src/build/f", _size(), ".py")).when(_key() % 5 == 1, _text("/items/", _size())).when(_key() % 5 == 2, _text("Update  t", _size(), " SET a = 1")).when(_key() % 5 == 3, "plain words").otherwise(_text("C:\\x", _size()))
    sql, effect = s.looks_like_sql(c), s.sql_effect(c)
    return table(spark, sf_dir, "part").select(
        "p_partkey", s.looks_like_path(c).alias("is_path"), s.looks_like_endpoint(c).alias("is_endpoint"), sql.alias("is_sql"), s.is_absolute_path(c).alias("is_absolute"), s.under_path(c, ["build"]).alias("is_ignored"),
        F.when(sql, effect.verb).alias("verb"), F.when(sql, effect.target).alias("target"),
    )


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'null' WHEN 2 THEN '{"a":' || p_size || '}' ELSE '"w' || p_size || '"' END AS value, 'redacted:' || sha256(p_name) AS api_key, p_brand AS brand, p_partkey % 3 - CASE WHEN p_partkey % 4 = 3 THEN 4 ELSE 0 END AS rank FROM part WHERE p_partkey % 4 <> 3
    UNION ALL SELECT p_partkey, '"w' || p_size || '"', 'redacted:' || sha256(p_name), p_brand, -1 FROM part WHERE p_partkey % 4 = 3
""")
def values_and_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(_key() % 4 == 0, " TRUE").when(_key() % 4 == 1, "None").when(_key() % 4 == 2, _text('{ "a" : ', _size(), "}")).otherwise(_text("w", _size()))
    kept = s.redacted(F.create_map(F.lit("Api_Key"), F.col("p_name"), F.lit("brand"), _brand()))
    level = F.when(_key() % 4 == 3, "none").otherwise(F.get(F.array(*map(F.lit, ["low", "medium", "high"])), (_key() % 3).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", s.parse_value(text).alias("value"), kept["Api_Key"].alias("api_key"), kept["brand"].alias("brand"), s.rank_confidence(level).cast("long").alias("rank"))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_uids, TRUE AS all_shaped, TRUE AS all_stable FROM part")
def deterministic_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = s.stable_uid(F.lit("block"), F.col("p_name"), _key())
    shaped = F.bool_and(uid.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.count_distinct(uid).alias("n_uids"), shaped.alias("all_shaped"), F.bool_and(uid == s.stable_uid(F.lit("block"), F.col("p_name"), _key())).alias("all_stable"))


@query("SELECT doc_id, strlen(text) < 256 AS plain, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sg.encoded(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return sg.decoded(stored, "doc_id").select("doc_id", "plain", F.sha2("text", 256).alias("digest"))


# sources and sinks over fixture rows


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'python' WHEN page_id % 3 = 1 THEN 'css' END AS language, page_id % 2 = 0 AS watched FROM pages")
def languages_and_watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.when(k % 2 == 0, "src/f").otherwise("node_modules/f"), k, F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".css").otherwise(".bin"))
    language = F.coalesce(*[F.when(path.endswith(x), n) for x, n in d.LANGUAGES.items()])
    return table(spark, sf_dir, "pages").select("page_id", language.alias("language"), files.is_watched(path, [".py", ".css", ".bin"], ["node_modules"]).alias("watched"))


@query("SELECT CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'css' ELSE 'None' END AS key, n FROM (SELECT page_id % 3 AS k, count(*) AS n FROM pages GROUP BY 1)")
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return d.count_by(table(spark, sf_dir, "pages"), F.when(k % 3 == 0, "python").when(k % 3 == 1, "css"))


_GO = "'package m\n\ntype T' || p_size || ' struct {\n\tA int\n}\n\nconst C' || p_size || ' = 1\n\nvar V = 2\n\nfunc F' || p_partkey || '(x int) int {\n\treturn x\n}\n\nfunc (t *T' || p_size || ') M() {\n}\n'"


@query("""
    SELECT p_partkey, s.symbol, s.kind FROM part, (SELECT unnest(['T', 'C', 'V', 'F', 'M']) AS w) x, LATERAL (SELECT CASE w WHEN 'T' THEN 'T' || p_size WHEN 'C' THEN 'C' || p_size WHEN 'V' THEN 'V' WHEN 'F' THEN 'F' || p_partkey ELSE 'T' || p_size || '.M' END AS symbol,
      CASE w WHEN 'T' THEN 'type' WHEN 'C' THEN 'const' WHEN 'V' THEN 'var' WHEN 'F' THEN 'function' ELSE 'method' END AS kind) s
""")
def go_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_GO.replace("\n", "\\n").replace("\t", "\\t")).alias("text"))
    return extract.units(texts, "p_partkey", "text", extract.go_units).select("p_partkey", "symbol", "kind")


_RUST = "'mod m {\n    pub struct S' || p_size || ' { a: u8 }\n    impl S' || p_size || ' {\n        fn f(&self) -> u8 { 1 }\n    }\n    impl S' || p_size || ' { fn g() {} }\n}\n// fn no() {}\nenum E { A }\ntrait W { fn t(); }\n'"


@query("""
    SELECT p_partkey, CASE i WHEN 0 THEN 'm' WHEN 1 THEN 'm::S' || p_size WHEN 2 THEN 'm::impl S' || p_size || '[1]' WHEN 3 THEN 'm::impl S' || p_size || '[1]::f' WHEN 4 THEN 'm::impl S' || p_size || '[2]' WHEN 5 THEN 'm::impl S' || p_size || '[2]::g' WHEN 6 THEN 'E' WHEN 7 THEN 'W' ELSE 'W::t' END AS symbol,
           CASE i WHEN 0 THEN 'module' WHEN 1 THEN 'struct' WHEN 2 THEN 'impl' WHEN 3 THEN 'method' WHEN 4 THEN 'impl' WHEN 5 THEN 'method' WHEN 6 THEN 'enum' WHEN 7 THEN 'trait' ELSE 'method' END AS kind, CASE WHEN i IN (3, 5) THEN 2 WHEN i IN (1, 2, 4) THEN 1 WHEN i = 8 THEN 1 ELSE 0 END AS depth
    FROM part, (SELECT unnest(range(9)) AS i)
""")
def rust_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_RUST.replace("\n", "\\n")).alias("text"))
    got = extract.units(texts, "p_partkey", "text", extract.rust_units)
    return got.select("p_partkey", "symbol", "kind", (F.size(F.split("symbol", "::")) - 1).alias("depth"))


_PY = "'import os.path as p, sys\nfrom a.b import c as d\n\nclass K' || p_size || ':\n    def set(self, v):\n        self.x = v + 1\n\n    def get(self):\n        return self.x\n\ndef w' || p_partkey || '(a, b):\n    return d(a, b)\n\ndef n(a):\n    print(a)\n    return d(a, 1)\n'"


@query("SELECT p_partkey, 'w' || p_partkey AS symbol, 'd' AS wrapper_target FROM part")
def trivial_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PY.replace("\n", "\\n")).alias("text"))
    return extract.python_facts(texts, "p_partkey", "text").where("wrapper_target is not null").select("p_partkey", "symbol", "wrapper_target")


@query("""
    SELECT p_partkey, s.* FROM part, LATERAL (SELECT 'K' || p_size || '.set' AS symbol, '' AS calls, 'v' AS roots, '' AS reads, 'x<-v + 1' AS writes UNION ALL SELECT 'K' || p_size || '.get', '', '', 'x', ''
      UNION ALL SELECT 'w' || p_partkey, 'd', 'a,b,d', '', '' UNION ALL SELECT 'n', 'print,d', 'a,d,print', '', '') s
""")
def python_unit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PY.replace("\n", "\\n")).alias("text"))
    facts = extract.python_facts(texts, "p_partkey", "text")
    return facts.select("p_partkey", "symbol", *[F.array_join(c, ",").alias(c) for c in ("calls", "roots", "reads", "writes")])


@query("SELECT p_partkey, 'a.b,os.path,sys' AS imports, 'd,n,print,w' || p_partkey AS names FROM part")
def module_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PY.replace("\n", "\\n")).alias("text"))
    got = extract.module_facts(texts, "p_partkey", "text")
    return got.select("p_partkey", F.array_join("imports", ",").alias("imports"), F.array_join(F.array_sort(F.array_union("called", F.array(F.lit("n"), F.concat(F.lit("w"), "p_partkey")))), ",").alias("names"))


# aggregates and lookups over records


@query("SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS shards FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def ids_in_many_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("shard"))
    return sg.in_many(rows, "id", "shard").select("id", F.array_join("places", ",").alias("shards"))


@query("SELECT string_agg(p_name, ',' ORDER BY p_name) AS repeated, count(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 30)")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.repeated(table(spark, sf_dir, "part"), "p_name", more_than=30).agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("repeated"), F.count("*").alias("n"))


@query("SELECT lower(replace(p_brand, '#', '')) AS shard, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1")
def shard_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sg.bucketed(table(spark, sf_dir, "part"), s.shard_name(_brand()), "p_partkey")
    return got.select("shard", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""
    WITH c AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS closure FROM lineitem GROUP BY 1)
    SELECT id, len(closure) AS closure_size, CASE WHEN len(closure) <= 3 THEN array_to_string(closure, ',') END AS closure, CASE WHEN len(closure) > 3 THEN sha256(array_to_string(list_sort(list_distinct(list_append(closure, id))), ',')) END AS component FROM c
""")
def impact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    closures = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_partkey").cast("long").alias("member"))
    return sg.impact_objects(closures, inline=3).withColumn("closure", F.array_join(F.col("closure").cast("array<string>"), ",")).withColumn("closure_size", F.col("closure_size").cast("long"))


@query("SELECT p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 250")
def pages_up_to_a_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy("p_name", "p_partkey").limit(250).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("uid"), F.when(_key() % 2 == 0, "77").otherwise("none").alias("external_id"))
    return sg.lookup(rows, "77").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'ring') AND (p_size, p_partkey) > (10, 500) ORDER BY p_size, p_partkey LIMIT 40")
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.bounded_scan(table(spark, sf_dir, "part"), {"p_type": "ECONOMY"}, "RING", ["p_name"], ["p_size", "p_partkey"], after=(10, 500), limit=40).select("p_partkey")


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'main' ELSE 's' || c_custkey % 4 END AS shard, count(*) AS n FROM customer GROUP BY 1")
def sharded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    origin = c.where(k % 4 != 0).select(k.alias("id"), F.concat(F.lit("s"), k % 4).alias("source"))
    return sg.with_origin(c.select(k.alias("id")), origin, "main").groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("n"))


# suggestions


@query("""
    WITH t AS (SELECT p_partkey, unnest(['symbol', 'symbol', 'imports']) AS src, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) AS token FROM part)
    SELECT p_partkey, token, CAST(sum(CASE src WHEN 'symbol' THEN 3.0 ELSE 0.5 END) AS DOUBLE) AS weight FROM t GROUP BY 1, 2
""")
def behaviour_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("symbol"), F.array(F.lower("p_type")).alias("imports"))
    return sg.fingerprint(rows, "p_partkey", {"symbol": 3.0, "imports": 0.5})


@query("""
    WITH f AS (SELECT p_partkey AS id, p_brand AS domain, p_size AS token, 1.0 AS w FROM part),
    p AS (SELECT domain, token, sum(w) AS pw FROM f GROUP BY 1, 2)
    SELECT f.id, p.domain, CAST(sum(least(f.w, p.pw - CASE WHEN p.domain = f.domain THEN f.w ELSE 0 END)) AS DOUBLE) AS score
    FROM f JOIN p USING (token) WHERE p.pw - CASE WHEN p.domain = f.domain THEN f.w ELSE 0 END > 0 GROUP BY 1, 2
""")
def leave_one_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"), F.col("p_size").alias("token"), F.lit(1.0).alias("weight"))
    return sg.leave_one_out(rows)


@query("""
    WITH c AS (SELECT c_custkey AS id, unnest([1, 2, 3, 4]) AS slot, unnest([lower(c_mktsegment), 'x' || c_custkey % 2, lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'x1' END]) AS text FROM customer)
    SELECT id, CAST(slot AS INTEGER) AS slot, CASE WHEN text IS NULL OR row_number() OVER (PARTITION BY id, text ORDER BY slot) > 1 THEN '-' ELSE text END AS text FROM c
""")
def slots_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    slots = F.array(m, F.concat(F.lit(" X"), k % 2), F.lower(m), F.when(k % 3 == 0, "x1"))
    return sg.distinct_slots(table(spark, sf_dir, "customer").select(k.alias("id"), F.posexplode(slots).alias("slot", "text")).withColumn("slot", F.col("slot") + 1))


@query("""
    WITH u AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'find' ELSE 'build' END AS action, 'part ' || s_suppkey % 7 || ' list' AS object FROM supplier),
    e AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'find' ELSE 'send' END AS action, 'part ' || s_suppkey % 5 || ' list' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' now' END AS object, 'P' || s_suppkey AS text FROM supplier),
    x AS (SELECT u.id, min(e.ord) AS ord FROM u JOIN e USING (action, object) GROUP BY 1),
    o AS (SELECT u.id, e.ord, len(list_intersect(string_split(u.object, ' '), string_split(e.object, ' '))) AS shared FROM u JOIN e ON u.action = 'find' AND e.action = 'find'),
    r AS (SELECT id, arg_min(ord, (-shared, ord)) AS ord FROM o WHERE shared >= 2 GROUP BY 1)
    SELECT u.id, 'P' || coalesce(x.ord, r.ord) AS text FROM u LEFT JOIN x USING (id) LEFT JOIN r USING (id) WHERE coalesce(x.ord, r.ord) IS NOT NULL
""")
def existing_purpose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sup = table(spark, sf_dir, "supplier")
    units = sup.select(k.alias("id"), F.when(k % 2 == 0, "find").otherwise("build").alias("action"), F.concat(F.lit("part "), k % 7, F.lit(" list")).alias("object"))
    known = sup.select(k.alias("ord"), F.when(k % 3 == 0, "find").otherwise("send").alias("action"), F.concat(F.lit("part "), k % 5, F.lit(" list"), F.when(k % 4 == 0, "").otherwise(" now")).alias("object"), F.concat(F.lit("P"), k).alias("text"))
    return sg.existing_purpose(units, known, ["find", "get"])


@query("SELECT p_partkey, 'find' AS action, CASE WHEN p_size % 2 = 0 THEN 'big items' ELSE 'rows' END AS object, 'for ' || lower(p_brand) AS qualifiers FROM part")
def purpose_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.when(_size() % 2 == 0, "findBigItems").otherwise("Store.get_rows")
    return sg.purpose_facts(table(spark, sf_dir, "part"), "p_partkey", symbol, _text("Looks up things for ", _brand(), ". More."), {"get": "find", "looks": "find"})
