"""Texts that look the same but are made of different characters (problem 2), over :mod:`.consistent`.

Only 24 bytes a row are kept for the comparison: the id and hashes of the consistent form and of the text.  Groups of
one form are narrowed by a pre-aggregated min/max of the text hash, so a comment that a third of all rows repeat in one
spelling costs one partial row a task; the distinct spellings of the forms that are left are joined with themselves,
and their rows are written out at the end, by spelling.  Rows of equal spelling never meet.

Defined results: null, empty and blank texts never pair; equal strings never pair; a null dataset is a dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .consistent import consistent_form


def with_consistent_text(records: DataFrame, text: str = "text", out: str = "consistent_text") -> DataFrame:
    """The rows with their text in the consistent form (null stays null)."""
    return records.withColumn(out, consistent_form(F.col(text)))


def _hashed(records: DataFrame) -> DataFrame:
    form = records.where("text is not null and record_id is not null").select(
        "record_id", F.coalesce("dataset", F.lit("")).alias("dataset"), "text", consistent_form(F.col("text")).alias("form")
    )
    # 96 bits of the form: 64 to join on and 32 to check
    return form.where("form <> ''").select(
        "record_id",
        F.xxhash64("dataset", "form").alias("form_key"),
        F.hash("form", "dataset").alias("form_check"),
        F.xxhash64("text").alias("spelling"),
    )


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """record_a < record_b of one dataset whose texts look the same but are different strings."""
    h = cut(_hashed(records))
    mixed = h.groupBy("form_key", "form_check").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi")
    rows = h.join(mixed.select("form_key", "form_check"), ["form_key", "form_check"])
    kinds = rows.select("form_key", "form_check", "spelling").distinct()
    form = ["form_key", "form_check"]
    spelled = kinds.withColumnRenamed("spelling", "sa").join(kinds.withColumnRenamed("spelling", "sb"), form).where("sa < sb")
    a = rows.select(*form, F.col("record_id").alias("a"), F.col("spelling").alias("sa"))
    b = rows.select(*form, F.col("record_id").alias("b"), F.col("spelling").alias("sb"))
    pairs = spelled.join(a, [*form, "sa"]).join(b, [*form, "sb"])
    return pairs.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"))


def spellings(records: DataFrame) -> DataFrame:
    """form_key, n_rows, n_spellings of every form with more than one spelling."""
    h = _hashed(records).groupBy("form_key", "form_check", "spelling").agg(F.count("*").alias("n"))
    return (
        h.groupBy("form_key", "form_check")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
        .where("n_spellings > 1")
        .select("form_key", "n_rows", "n_spellings")
    )
