"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. Documents that a stage removes are gone for the next one, and
line dedup changes texts. n_chars follows the text.

Defined results: texts that are null or empty from the start pass every stage; repeated rows are judged alike, and
near-duplicate removal leaves one of those that have words; rows that share an id but not the text are told apart;
ties go to the smallest id; very long texts are read whole; an empty table gives an empty result; columns beyond
those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_templates, quality_model, shingle_forest
from .shared import Scratch, owned, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer (fitted on these documents and the labels table) doesn't reject."""
    docs = docs.select(*COLUMNS)
    model = quality_model.fit(spark, docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).where(F.col("quality_score") >= quality_model.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are gone from all but their first document; so is a document of which nothing
    but white space is left, as all of it stands in earlier ones."""
    out = line_templates.dedup_lines(spark, docs)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates; a repeated row once."""
    return shingle_forest.one_of_each(spark, docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode_digests(docs, bpe.default_vocabulary())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminated", decontaminated), ("tokens", tokens)]

#: The scorer and the token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read or kept for itself is deleted once its result is written."""
    kept, docs, last = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with owned():
            docs = kept.keep(stage(spark, docs, sf_dir), name)
        if last:
            kept.drop(last)
        last = name
    return docs
