"""The queries of the training-data operators, over whole tables with the operators' defaults.

None of them has an SQL twin: each is tested against a brute-force version, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelight.common import table
from quirelight.llm import bpe, leaks, levels, neardup, pages, quality, repeats, subjects

#: Where the public vocabularies lie; only the driver reads them.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, d, "documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeats(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "tagged_tokens"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_classes(table(spark, d, "tagged_tokens"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.boilerplate(table(spark, d, "documents"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_bodies(table(spark, d, "documents"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return levels.levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_quality, p2_found, p2_clean, p3_found, p3_classes, p4_found, p5_found, p5_bodies, p6_ids, p7_found, p7_spans, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {}
