"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import mixing, pieces, quality_knn, robust, simhash
from tracksmith.llm.queries import PIECES
from tracksmith.llm.text import fold, labels
from tracksmith.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels outside the held-out fifth."""
    known = labels(spark, sf_dir).where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.fit(docs.select("doc_id", "text"), known)
    return quality_knn.score(docs.select(*COLUMNS), model, out="score").where("score >= 0.3").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return robust.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the least id."""
    return simhash.keep_one_similar(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's budget is cut there."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every mixed document, and whether decoding them gives its text back."""
    return pieces.encode_decode(docs.select(*COLUMNS), PIECES).select("doc_id", "source", "ids", "n_pieces", "exact")


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("mixing", mixture), ("sentencepiece", tokens)]

#: A latent-space classifier and BK-tree components have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
