"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import read_table
from .decontaminate import contaminated
from .fim import FIM_RATE, SPM_RATE, fill_in_middle, restored
from .fim import SEED as FIM_SEED
from .jaccard import jaccard_components
from .language import add_language, held_out
from .licenses import license_scan
from .lines import MIN_SITES, line_dedup
from .manifest import FANOUT, verified_manifest
from .secrets import find_secrets
from .simhash import hex_digits, simhash_components
from .substrings import substring_dedup
from .tokenfile import token_file
from .topk import K, QUERY_STEP, SCALE, exact_top_k


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"), vocabulary=tokenizer_path("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return add_language(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(damaged, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified_manifest(read_table(spark, sf_dir, "documents"), tampered)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_file": op4_token_file,
    "op5_decontaminate": op5_decontaminate,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string: eight shifts a byte with the reflected polynomial 0xEDB88320."""
    bits = "list_reduce(list_concat([xor(a, c)], CAST(range(8) AS UBIGINT[])), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::UBIGINT) ELSE s >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda a, c: {bits}), 4294967295::UBIGINT)"


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


def _siblings_sql(node: str) -> str:
    """Digests before and after a node in its run."""
    run = f"PARTITION BY grp, level, idx // {FANOUT} ORDER BY idx ROWS BETWEEN"
    return f"""SELECT grp, level, idx, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {node} WHERE n > 1"""


def _climb_sql(name: str, start: str) -> str:
    return f"""{name}(grp, level, idx, digest, n) AS (
          {start}
          UNION ALL
          SELECT grp, level + 1, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx)), max((n + {FANOUT - 1}) // {FANOUT})
          FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {FANOUT})"""


ORACLE_SQL: dict[str, str] = {
    "op8_exact_top_k": f"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= {K}
    """,
    "op10_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents),
        b AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
        m AS (SELECT l.*, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON l.line = b.line),
        d AS (
          SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_hit,
                 count(*) FILTER (WHERE NOT hit AND trim(line) <> '') AS n_own,
                 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit), '') AS kept
          FROM m GROUP BY doc_id)
        SELECT o.doc_id, coalesce(d.n_lines, 0) AS n_lines,
               CASE WHEN d.n_hit > 0 AND d.n_own > 0 THEN d.n_hit ELSE 0 END AS n_removed,
               sha256(CASE WHEN d.n_hit > 0 AND d.n_own > 0 THEN d.kept ELSE coalesce(o.text, '') END) AS text_sha256
        FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (
          SELECT *, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
        l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, {_leaf_sql("text")} AS leaf, {_leaf_sql("now")} AS leaf_now FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l),
        {_climb_sql("tree", "SELECT grp, 0, idx, leaf, n FROM p")},
        subs AS (SELECT grp AS of, level AS height, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
        {_climb_sql("top", "SELECT '', 0, idx, digest, n FROM subs")},
        s1 AS ({_siblings_sql("tree")}),
        s2 AS ({_siblings_sql("top")}),
        w1(doc_id, leaf, grp, level, idx, acc, proof) AS (
          SELECT doc_id, leaf, grp, 0, idx, leaf_now, '' FROM p
          UNION ALL
          SELECT w.doc_id, w.leaf, w.grp, w.level + 1, w.idx // {FANOUT}, sha256(s.before || w.acc || s.after), w.proof || s.before || s.after
          FROM w1 w JOIN s1 s ON w.grp = s.grp AND w.level = s.level AND w.idx = s.idx),
        w2(doc_id, leaf, subroot, level, idx, acc, proof) AS (
          SELECT w.doc_id, w.leaf, subs.digest, 0, subs.idx, w.acc, w.proof FROM w1 w JOIN subs ON w.grp = subs.of AND w.level = subs.height
          UNION ALL
          SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.idx // {FANOUT}, sha256(s.before || w.acc || s.after), w.proof || s.before || s.after
          FROM w2 w JOIN s2 s ON w.level = s.level AND w.idx = s.idx)
        SELECT w.doc_id, w.leaf, w.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.digest AS verified
        FROM w2 w JOIN top r ON r.n = 1 AND w.level = r.level
    """,
    "op13_fill_in_middle": f"""
        WITH h AS (
          SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                 list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('{FIM_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
          FROM documents),
        c AS (
          SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {FIM_RATE} THEN 'plain'
                      WHEN h[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
          FROM h),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
