"""A corpus pipeline of documents: each stage calls one operator of quernstone.llm.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import bpe_round_trip
from quernstone.llm.common import remove_folder, shared_folder, without_ids
from quernstone.llm.decontaminate import clean
from quernstone.llm.jaccard import jaccard_components
from quernstone.llm.language import add_language
from quernstone.llm.lines import line_dedup
from quernstone.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; a missing lang is filled in."""
    told = add_language(docs).where(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars follows the text."""
    kept = line_dedup(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    groups = jaccard_components(docs, k=5, num=80, den=100)
    return without_ids(docs, groups.where("component_id <> doc_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left."""
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, which cuts the lineage, and deleted after the next."""
    folder = shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
