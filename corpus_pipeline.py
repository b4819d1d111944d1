"""Cleans ``documents`` for training: each stage works on all rows that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.llm import bpe, decontam, langid, pii, simhash
from feedops.llm.common import keep

#: A document whose best language has a mean probability not this part of the way from chance to certainty is in none of the languages learned.
ABOVE_CHANCE = 0.3
#: Fingerprints of near copies differ in so many bits at most; they are made of shingles of so many words.
NEAR_BITS, NEAR_WORDS = 4, 4
KEY = b"a key of the corpus"


def least_language(languages: int) -> float:
    """The mean probability that the best of so many languages must have; a single one tells nothing apart."""
    return 1 / languages + ABOVE_CHANCE * (1 - 1 / languages) if languages > 1 else 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without letters or below ``least_language`` go."""
    network = langid.train(docs)
    return langid.keep_known(docs, network, least_language(len(network.labels) if network else 0))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints link: the one with the smallest doc_id."""
    return simhash.keep_first(docs, NEAR_BITS, NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return pii.replace(docs, KEY).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("privacy", privacy), ("tokens", tokens)]

#: No SQL expresses the trained, hashed and keyed stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; between stages the rows lie as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
