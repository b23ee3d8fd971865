"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes every stage as a Parquet table in the shared folder and
reads it again as the next one's documents.

Defined results of every stage: null and empty texts stay until packing, where they are the end
id alone; rows with one doc_id and different texts are documents of their own; of rows equal in
doc_id and text near_duplicates keeps one; an empty table gives an empty one; further columns,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import jaccard, mixing, packing, quality_lm, suffix_dedup
from tesserae.llm.common import documents, materialize

#: A passage has so many bytes or over so many words; shorter repeats are taken for phrases.
PASSAGE_BYTES = 256
PASSAGE_WORDS = 50
#: Share of all tokens that the mixture keeps, each document at most once.
MIX_PERCENT = 90


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not far out in their language."""
    return quality_lm.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more."""
    return jaccard.one_of_each(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur twice."""
    return suffix_dedup.clean_texts(docs, PASSAGE_BYTES, PASSAGE_WORDS + 1)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the tree's target weights."""
    return mixing.chosen(docs, mixing.QUERY_WEIGHTS, MIX_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]
#: The model of the first stage and the suffix arrays of the third have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE_QUERIES: dict[str, str] = {}
