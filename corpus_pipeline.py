"""A training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table, written
from shelfmark.llm.decontam import decontaminate
from shelfmark.llm.neardup import near_duplicates
from shelfmark.llm.pieces import encode_pieces
from shelfmark.llm.queries import PIECE_MODEL
from shelfmark.llm.repeats import remove_repeats
from shelfmark.llm.toxicity import score_toxicity, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: an Arrow batch of whole texts is held by the JVM and by a Python worker, on its way there and on its way back
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with Arrow batches of at most ``BATCH_BYTES`` (or one row) from here on, where the session names no limit."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_LIMIT, None) is None:
            spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    docs = docs.select(*COLUMNS)
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))).where(~F.col("toxic")).select(*COLUMNS)


@small_batches
def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id."""
    docs = docs.select(*COLUMNS)
    out = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(out, "doc_id", "left_anti").select(*COLUMNS)


@small_batches
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; those of which nothing is left go."""
    kept = remove_repeats(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"))
    kept = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@small_batches
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without their stray benchmark passages."""
    clean = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated"))
    return clean.select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source", F.when(F.col("n_hit") > 0, F.length("cleaned_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@small_batches
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with what its N best segmentations score."""
    return encode_pieces(docs.select("doc_id", "text", "lang", "source"), PIECE_MODEL).drop("text", "n_best_cuts")


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("substrings", substrings), ("benchmark", benchmark), ("sentencepiece", sentencepiece)]

#: SQL cannot train the classifier or search the lattice; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
