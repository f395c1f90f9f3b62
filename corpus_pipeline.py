"""A training corpus from ``documents``: filter, deduplicate, mix and tokenize, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import exact_dedup, mixing, near_dedup, pieces, quality
from lendscope.llm.common import saved, small_batches, table
from lendscope.sources.workspace import use_local_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; learned from the labelled documents outside the held-out fold."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without white space the longest stays, then the smallest id."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the smallest id stays."""
    return near_dedup.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix passes over it; documents without a turn or without words go."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the piece ids and the decoded text of every remaining row."""
    from lendscope.llm.queries import piece_model

    small_batches(spark)
    coded = docs.select("doc_id", "source", pieces.encode_column(F.col("text"), piece_model()).alias("piece"))
    return coded.select("doc_id", "source", F.size("piece.ids").cast("long").alias("n_tokens"), "piece.ids", "piece.decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The first stage is a trained network, which SQL cannot express; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again by the next."""
    use_local_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
