"""A corpus from documents to packed sequences; each stage is written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns beyond those of documents: those
beyond are left out, null texts count as empty and stay null until they are packed as their end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import common, decontam, jaccard, packing, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of the learnable folds."""
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), common.crc_fold("doc_id", 5) != 0)
    return toxicity.score(docs, net, *COLUMNS).where("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_first(docs.select(COLUMNS), n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.clean(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("PII", redact), ("packing", pack)]

#: SQL expresses neither the classifier nor the packing; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's input is removed as soon as the next stage's table is whole."""
    docs, scratch = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES:
        table = name.replace(" ", "-")
        docs = scratch.write(table, stage(spark, docs, sf_dir))
        scratch.keep_only(table)
    return docs
