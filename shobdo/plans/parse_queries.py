"""Queries of the row parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parse import failures, failures_by_file, parse_lines, typed


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return parse_lines(read(f"{sf_dir}/raw_lines.parquet"), read(f"{sf_dir}/file_inventory.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return failures(read(f"{sf_dir}/raw_lines.parquet"), read(f"{sf_dir}/file_inventory.parquet"))


def p4_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(_parsed(spark, sf_dir)).select("line_id", "text", "label", "article_id", "published")


def p4_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_by_file(_parsed(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_typed": p4_typed, "p4_by_file": p4_by_file}
SQL: dict[str, str] = {}
