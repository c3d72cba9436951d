"""The corpus pipeline: quality, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

Null and empty texts, null and repeated ids, empty tables and extra columns are
handled as the operators' docstrings say: an empty table gives an empty one, without
good labels every document is kept, null texts pass the first three stages, and a
document without text is packed as its end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import line_dedup, ngram_join, packing, quality
from storyline.llm.common import new_path, scratch, unused, written

TOKENIZER = "word_bpe_49k.json"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.resampled(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that others hold first; n_chars follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest id.

    Rows may repeat an id, with equal or different texts; each is a row of its own
    component, and of those with the smallest id the first by the text's hash stays.
    Rows without an id or without words stay.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # numbers of rows hold once the table is written
        row = unused(docs.columns, "row")
        rows = written(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
        groups = ngram_join.ngram_join(rows, row).where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
        named = groups.join(rows.select(row, "doc_id", F.sha2("text", 256).alias("hash")), row)
        firsts = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
        return rows.join(groups.join(firsts, row, "left_anti"), row, "left_anti").select(*own)
    others = ngram_join.ngram_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        scratch(spark, path)
        docs = spark.read.parquet(path)
    return docs
