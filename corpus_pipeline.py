"""The corpus pipeline: language, lines, near duplicates, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's ``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmask.llm import language, lines, minhash, mixing, packing
from quillmask.llm.staging import stage, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHINGLE = 5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those in none of the languages that the labels name."""
    return language.identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document; documents of nothing else go."""
    return lines.without_boilerplate(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return minhash.one_of_each(docs, SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix", mix),
    ("pack", pack),
]

#: Classifiers, sketches and tokenisers are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
