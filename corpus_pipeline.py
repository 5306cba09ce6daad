"""The training-corpus pipeline: four stages, each over all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaris.llm.common import scratch_path, table
from sonaris.llm.langid import keep_known_languages
from sonaris.llm.near_dup import near_duplicates
from sonaris.llm.packing import pack_documents
from sonaris.llm.quality import quality_rules
from sonaris.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the others go. Profiles and limits are learned from all labelled
    documents of the table, without the fold that the language query holds out."""
    return keep_known_languages(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent on their host."""
    judged = quality_rules(docs).where("kept")
    changed = F.col("n_frequent_words") > 0
    judged = judged.withColumn("n_chars", F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return judged.withColumn("text", F.col("clean_text")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "__kept"), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, each with its place in a sequence of 2048 tokens."""
    return pack_documents(docs)


def _shipped(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [("language", _shipped(language)), ("quality", _shipped(quality)), ("near_dedup", _shipped(near_dedup)), ("packing", _shipped(packing))]

#: Language profiles and tokens are beyond SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
