"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.bytebpe import decode_ids, encode_texts, rank_file
from shelfmark.llm.common import table
from shelfmark.llm.decontam import decontaminate
from shelfmark.llm.licenses import scan_licenses
from shelfmark.llm.lm import score_corpus
from shelfmark.llm.neardup import near_duplicates
from shelfmark.llm.oracles import ORACLES
from shelfmark.llm.pieces import encode_pieces
from shelfmark.llm.quality import clean_lines
from shelfmark.llm.repeats import remove_repeats
from shelfmark.llm.sharding import assign_shards
from shelfmark.llm.spelling import spelling_variants
from shelfmark.llm.toxicity import score_toxicity, train_toxicity
from shelfmark.llm.warc import archive_round_trip
from shelfmark.llm.whiten import whitened_components

PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, PIECE_MODEL, with_ids=False).drop("text", "piece_ids")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).drop("text", "cleaned_text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "cleaned_text")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encode_texts(docs, ranks).select("doc_id", "n_tokens", "ids_sha256", "token_ids")
    return decode_ids(ids, ranks, with_bytes=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_sharding, op3_substring_dedup, op4_sentencepiece, op5_warc, op6_lm_score, op7_licenses, op8_toxicity, op9_quality, op10_decontamination, op11_spelling, op12_byte_bpe, op13_whitening)}

__all__ = ["ORACLES", "QUERIES"]
