"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, html_text, langid, license, lm, neardup, packing, quality, url_filter
from .common import table
from .oracle import ORACLES


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, counts=url_filter.vocabulary(pages)).select("page_id", "host", "path", "rule", "verdict")


def op3_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_lm_score(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"), modulus=5, remainder=1)


def op5_line_quality(spark, sf_dir):
    return quality.line_quality(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), modulus=4, remainder=2).select(
        "doc_id", "held_out", "lang_pred", F.col("score").cast("double").alias("score")
    )


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filter, op3_ann, op4_lm_score, op5_line_quality, op6_near_duplicates, op7_html_text, op8_license_scan, op9_byte_bpe, op10_language_id)}
__all__ = ["ORACLES", "QUERIES"]
