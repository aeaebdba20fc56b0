"""Empty tables, nulls, very long texts, repeated rows and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from quernstone.llm import bpe, common, decontaminate, fim, jaccard, language, licenses, lines, manifest, secrets, simhash, substrings, tokenfile, topk  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Columns of documents, and beside them names that operators use inside or give.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, score string, lang_pred string, n_lines string, n_removed string, _doc string, _hits string, _lines string, cid string, d string, th string, key string, n string, pos string"
ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again"), (None, "one two three four five six"), (3, None), (4, "")]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


OPERATORS = {
    "licenses": lambda docs: licenses.license_scan(docs),
    "bpe": lambda docs: bpe.bpe_round_trip(docs, PATH),
    "substrings": lambda docs: substrings.substring_dedup(docs),
    "token_file": lambda docs: tokenfile.token_file(docs, PATH, 2),
    "jaccard": lambda docs: jaccard.jaccard_components(docs),
    "language": lambda docs: language.add_language(docs),
    "lines": lambda docs: lines.line_dedup(docs),
    "clean": lambda docs: decontaminate.clean(docs, bench(docs.sparkSession)),
    "contaminated": lambda docs: decontaminate.contaminated(docs, bench(docs.sparkSession)),
    "secrets": lambda docs: secrets.find_secrets(docs),
    "manifest": lambda docs: manifest.verified_manifest(docs),
    "simhash": lambda docs: simhash.simhash_components(docs),
    "fill_in_middle": lambda docs: fim.fill_in_middle(docs),
}
LONG = [" ".join(f"word{i * 7919 % 100_003}" for i in range(140_000)), "x" * 1_300_000, "ab \n" * 400_000]


def rows(texts):
    clash = ["clash"] * (len(SCHEMA.split(", ")) - 5)
    return [(i if i % 4 else None, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t), *clash) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_row(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    texts = [None, "", " ", "\n", "a", None, "same text of a few words\n" * 3, "same text of a few words\n" * 3, ITEMS[0][1], "é" * 900]
    docs = spark.createDataFrame(rows(texts) + rows(texts), SCHEMA)
    got = OPERATORS[name](docs)
    assert len(set(got.columns)) == len(got.columns)
    n = len(got.collect())
    if name == "contaminated":
        assert n == 2
    elif name == "clean":  # the item's text has no doc_id, so it stays
        assert n == 20
    elif name != "secrets":
        assert n == 20


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, name):
    docs = spark.createDataFrame(rows([*LONG, "short one"]), SCHEMA)
    n = OPERATORS[name](docs).count()
    assert n == (0 if name in ("contaminated", "secrets") else 4)


def test_clean_deletes_what_operators_keep(spark):
    docs = spark.createDataFrame(rows(["a b c d e f", "a b c d e f"]), SCHEMA)
    n = jaccard.jaccard_components(docs).count()
    folders = list(common._MADE[spark.sparkContext.applicationId])
    assert n == 2 and folders and common.clean(spark) == len(folders) and common.clean(spark) == 0
    at = spark._jvm.org.apache.hadoop.fs.Path(folders[-1])
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_vectors_of_no_table_and_of_none(spark):
    schema = "vec_id long, embedding array<float>, rank string, score string"
    assert topk.exact_top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(0, None, "c", "c"), (50, [], "c", "c"), (0, [1.0], "c", "c")], schema)).count() == 0


def test_benchmarks_without_items_take_nothing(spark):
    docs = spark.createDataFrame(rows(["a b c d e f g h"]), SCHEMA)
    for items in ([], [(1, None)], [(2, "...")]):
        assert decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 1


def test_pipeline_stages_keep_clean_documents_and_columns(spark, tmp_path):
    good = [f"page {i} tells of " + " ".join(f"thing{(i * 31 + j * j) % 977}" for j in range(60)) for i in range(40)]
    texts = [None, "", "123 456", *good, good[0], good[1] + " extra", f"before {ITEMS[0][1]} after"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [{0, 1, 2}, set(), {43, 44}, {45}]
    left = set(range(len(texts)))
    out = docs
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        out = stage(spark, out, str(tmp_path))
        left -= lost
        assert {r.doc_id for r in out.collect()} == left, name
        assert out.columns == docs.columns
    ended = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(ended) == left and min(ended.values()) > 60
    assert docs.where(F.col("doc_id") < 0).count() == 0
