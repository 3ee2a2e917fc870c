"""A corpus pipeline: quality rules, language ID, near-duplicates, packing.

Defined cases: a null or blank text fails the quality rules; null languages and sources only
leave their row out of what is learned of languages, and make a host of their own; a row
without an id goes through and, in near-dedup, stands for the documents of its text; of
repeated rows near-dedup keeps one; documents with equal limits or lengths are treated alike,
whatever their order, and a group of near-duplicates keeps its smallest id; a text of any
length is handled whole; columns other than id, text, lang, source and n_chars are passed on,
whatever their names, up to packing; an empty table gives an empty result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import langid, neardup, packing, quality
from gaugeframe.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their boilerplate lines; ``n_chars`` is the text's that is left."""
    kept = quality.keep_good(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence."""
    return langid.keep_sure(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality", quality_rules), ("language", language_id), ("dedup", near_dedup), ("packing", pack_sequences)]

#: SQL can't express the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
