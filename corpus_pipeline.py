"""The corpus pipeline: language ID, near-duplicates, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet and reads again as the next
one's docs. All but the last return the columns of ``documents``, whatever further ones there are. An empty table stays
empty. What ``run`` wrote for a stage is removed once the next one has read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, remove
from marlstone.llm.decontamination import without_contaminated
from marlstone.llm.language_id import UNDETERMINED, identify
from marlstone.llm.near_copies import forget, keep_one
from marlstone.llm.packing import pack
from marlstone.llm.pseudonyms import pseudonymise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document that the network's noise class claims, so that all languages together have less than this, is rejected.
LEAST_FIT = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts, texts without a letter, and those that are noise to the
    network rather than any language it has learned (other scripts, digits, markup, random letters)."""
    found = identify(spark, docs).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("fit") >= LEAST_FIT))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles: that of the
    smallest doc_id, the first row if it repeats. Null and empty texts are alike."""
    return keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a test item; null texts, and all texts if there are no items, stay."""
    return without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text. Rows are judged one by one, null texts stay null."""
    out = pseudonymise(docs).withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences: one row for each piece, with its ids; a null text is its end id alone."""
    return pack(spark, docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL can express none of the first three stages and the last; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = materialize(spark, stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        forget(spark)
        before = path
    return docs
