"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .leakage import leaked_items
from .lookalike import lookalike_pairs, spellings, with_consistent_text
from .mojibake import garbled_records, methods, restored_texts
from .neardup import NearDuplicates
from .overlap import CrossSplitOverlap, overlap_report
from .reading import profile, reading_levels, train
from .tokenize import encode_corpus


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_records(table(spark, sf_dir, "corpus_records"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_texts(table(spark, sf_dir, "corpus_records"))


def p3_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods(table(spark, sf_dir, "corpus_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents"), n=3, threshold=0.5).pairs().select("doc_a", "doc_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8).classes()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CrossSplitOverlap(table(spark, sf_dir, "corpus_records")).pairs().select("record_a", "record_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CrossSplitOverlap(table(spark, sf_dir, "corpus_records")).classes()


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CrossSplitOverlap(table(spark, sf_dir, "corpus_records")).class_links()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "corpus_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "corpus_records"))


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_consistent_text(table(spark, sf_dir, "corpus_records").select("record_id", "text")).drop("text")


def p2_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(table(spark, sf_dir, "corpus_records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reading_levels(docs, train(docs, table(spark, sf_dir, "reading_grades"))).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return profile(docs, p8_levels(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p1_links, p1_report, p2_found, p2_consistent, p2_spellings, p3_found, p3_restored, p3_methods, p5_found, p5_classes, p6_ids, p7_found, p7_spans, p8_levels, p8_profile)
}
SQL: dict[str, str] = {}
