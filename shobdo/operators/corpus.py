"""Corpus metrics: character classes, lengths, quality inventory, balance, flags.

Everything is one aggregate over the rows with partial sums before the shuffle.  Defined results: null text counts as ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import SPARK
from ..functions.text import BENGALI, char_class_counts
from .noise import spread


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return spread(df.select(*columns, F.coalesce("text", F.lit("")).alias("t")))


def char_class_composition(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Characters by class, all eight classes for every group."""
    named = char_class_counts(SPARK, "t")
    total = F.sum(F.length("t"))
    agg = _texts(df, by).groupBy(by).agg(*(F.sum(F.expr(e)).alias(c) for c, e in named.items()), total.alias("_all"))
    other = F.col("_all") - sum((F.col(c) for c in named), F.lit(0))
    rows = [F.struct(F.lit(c).alias("char_class"), (F.col(c) if c in named else other).alias("n")) for c in maps.CHAR_CLASSES]
    return agg.select(by, F.inline(F.array(*rows)))


def latin_share(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Latin letters over characters; 0 for empty text."""
    latin = F.expr(char_class_counts(SPARK, "t")["latin"])
    return _texts(df, key).select(key, F.coalesce(F.try_divide(latin.cast("double"), F.length("t")), F.lit(0.0)).alias("latin_share"))


def quality_inventory(df: DataFrame, *by: str) -> DataFrame:
    """A15 to A17 by group; distinct texts are counted by 96-bit hash, exactly but for collisions."""
    t = _texts(df, *by)
    rows = t.select(*by, F.xxhash64("t").alias("k"), F.hash("t").alias("k2"),
                    (~F.col("t").rlike(rf"[^{maps.WS}]")).cast("int").alias("empty"),
                    (~F.col("t").rlike(BENGALI)).cast("int").alias("zero"),
                    F.col("t").contains("�").cast("int").alias("lost"),
                    F.col("t").rlike(f"[{maps.EMOJI}]").cast("int").alias("emoji"))
    per_text = rows.groupBy(*by, "k", "k2").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("empty", "zero", "lost", "emoji")))
    return per_text.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), (F.sum("n") - F.count("*")).alias("n_duplicate_rows"),
        F.sum("empty").alias("n_empty_or_whitespace"), F.sum("zero").alias("n_zero_bangla"),
        F.sum("lost").alias("n_replacement_char"), F.sum("emoji").alias("n_emoji_bearing"),
    )


def lengths(df: DataFrame, *keep: str) -> DataFrame:
    """N clusters of each text."""
    return _texts(df, *keep).select(*keep, F.expr(SPARK.occurrences("t", maps.CLUSTER)).alias("n"))


def length_stats(df: DataFrame, *by: str) -> DataFrame:
    """Mean, upper median, share over the cap, by group.

    The median is read off counts of each length, so no group's lengths are collected."""
    counts = lengths(df, *by).groupBy(*by, "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    up = counts.withColumn("cum", F.sum("c").over(w.orderBy("n"))).withColumn("tot", F.sum("c").over(w))
    return up.groupBy(*by).agg(
        F.sum("c").alias("n_texts"), (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_clusters"),
        F.min(F.when(F.col("cum") > F.floor(F.col("tot") / 2), F.col("n"))).alias("median_clusters"),
        (F.lit(100.0) * F.sum(F.when(F.col("n") > maps.CER_CAP, F.col("c")).otherwise(0)) / F.sum("c")).alias("pct_over_cap"),
    )


#: Steps that one row is expanded to at a time
STEPS = 10_000


def length_ecdf(df: DataFrame, by: str = "dataset") -> DataFrame:
    """A step for every row of a group, ties one above the other: step (from 1), its length n and share step / rows.

    Rows of one length are counted first and written out again in blocks, so no group is sorted or gathered."""
    counts = lengths(df, by).groupBy(by, "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    upto = counts.withColumns({"last": F.sum("c").over(w.orderBy("n")), "total": F.sum("c").over(w)})
    blocks = upto.select(by, "n", "c", "last", "total", F.explode(F.sequence(F.lit(0), F.expr(f"int((c - 1) div {STEPS})"))).alias("b"))
    first = F.col("last") - F.col("c") + 1 + F.col("b") * STEPS
    steps = blocks.select(by, "n", "total", F.explode(F.sequence(first, F.least(first + STEPS - 1, F.col("last")))).alias("step"))
    return steps.select(by, "step", "n", (F.col("step") / F.col("total")).alias("share"))


def class_balance(df: DataFrame, *by: str) -> DataFrame:
    """Rows and percent of each label within a group."""
    c = df.groupBy(*by, F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def flag_vs_label(df: DataFrame, pattern: str, *by: str) -> DataFrame:
    """Label shares among rows whose text has the pattern and among the others."""
    f = df.select(*by, F.coalesce("text", F.lit("")).rlike(pattern).alias("flagged"), F.col("label").cast("string").alias("label"))
    c = f.groupBy(*by, "flagged", "label").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*by, "flagged")))


def bearing_rate(df: DataFrame, pattern: str, *by: str) -> DataFrame:
    """Rows with the pattern over rows."""
    hit = F.coalesce("text", F.lit("")).rlike(pattern).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(hit).alias("n_bearing"), F.avg(hit).alias("rate"))


def raw_final_delta(raw: DataFrame, final: DataFrame, *by: str) -> DataFrame:
    """Metrics of the same names of two inventories, unpivoted and compared."""
    names = [c for c in raw.columns if c not in by]

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(value)) for c in names))))

    both = long(raw, "raw_value").join(long(final, "final_value"), [*by, "metric"])
    pct = F.when(F.col("raw_value") == 0, 0.0).otherwise(F.lit(100.0) * F.try_divide("final_value", "raw_value"))
    return both.withColumn("delta", F.col("final_value") - F.col("raw_value")).withColumn("pct_of_raw", pct)


def with_class_percent(inventory: DataFrame, composition: DataFrame, by: str = "dataset") -> DataFrame:
    """An inventory with the percentages of the eight character classes as further metrics pct_<class>."""
    from .analysis import class_percent

    pct = class_percent(composition, by)
    return inventory.join(pct.select(by, *(F.col(c).alias(f"pct_{c}") for c in maps.CHAR_CLASSES)), by)
