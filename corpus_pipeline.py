"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's docs. All but the last return the columns of
documents.

Null doc_ids, null and empty texts and repeated rows pass through every stage
by its own rule, extra columns are kept up to the last one, and empty tables
give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import bpe, decontam, line_dedup, near_dups, quality
from quillframe.llm.common import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled rows of docs.

    Null texts score as empty ones; every row is judged by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines under repeated three-line windows go; n_chars is counted again."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, Jaccard similarity 0.8 or more.

    Texts without words, null ones among them, are one group. The least
    doc_id stays, nulls last; of rows that repeat it in a group one stays.
    """
    return near_dups.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and wordless texts and items match nothing; without items all stay.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, for every row; null texts as empty ones."""
    return bpe.digests(docs)


STAGES = [("quality", good), ("line_dedup", lines), ("simhash", near), ("decontamination", clean), ("bpe", tokens)]

#: The classifier's fit and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        docs = out if n == len(STAGES) else table(out)
    return docs
