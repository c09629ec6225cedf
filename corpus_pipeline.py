"""Five of the text operators as one pipeline: from raw documents to the tokens of a mix."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm import bpe, langid
from siterank.llm.common import stage, without
from siterank.llm.jaccard_join import jaccard_components
from siterank.llm.line_dedup import dedup_lines
from siterank.llm.mixing import repeated_documents


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go; a missing language is filled in."""
    models = langid.fit(langid.training_rows(docs))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    seen = langid.identify(rows, models, ("_row",)).where("not rejected")
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    columns["lang"] = F.coalesce("_row.lang", "lang_pred")
    return seen.select(*(columns[c].alias(c) for c in docs.columns))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and the documents that consist of nothing else."""
    lines = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return lines.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest id.

    Rows that repeat an id are one document and stay or go together. Rows without an id stay: nothing names them.
    """
    dropped, _ = stage(jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id"), "pipeline-dropped", free=True)
    return without(docs, dropped, "doc_id").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeated_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact): packed token ids, and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN, ("doc_id", "source", "text"))
    return back.select("doc_id", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", fresh_lines),
    ("jaccard_join", one_of_each_group),
    ("mix_sources", mixed_sources),
    ("byte_bpe", token_ids),
]
# Language models are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs, _ = stage(function(spark, docs, sf_dir), f"pipeline-{name}", free=True)
    return docs
