"""A corpus pipeline in five stages, each with one operator of newsloom.llm.

    language ID -> exact dedup -> SimHash near-dedup -> mixing to target weights -> byte-level BPE

Each stage takes the rows that the one before kept, of the columns of documents. The mix repeats rows, so that the
last stage returns a row for each copy.

Cases: documents of null or empty text, or without a letter, are in no known language and go in the first stage;
of repeated rows one stays after the second; rows with a null doc_id stay rows of their own; null sources are one
source; an empty table passes all stages without rows; columns that documents have besides are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, exact_dedup, language, mixing, simhash
from newsloom.llm.queries import page_facts
from newsloom.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, by their texts, pages and hosts; undetermined and doubtful ones go."""
    model = language.fit(docs)
    # a model of no language decides without evidence
    facts = page_facts(spark.read.parquet(f"{sf_dir}/pages.parquet")) if model.languages else None
    return language.known(docs, model, host=F.col("source"), facts_of=facts)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the row with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, one document: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, with what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode_texts)]

#: The stages train, hash and tokenise; SQL has no words for them. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
