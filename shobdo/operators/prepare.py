"""Cleaning, deduplication, splits, leakage and samples of labelled corpora.

Input rows are (record_id, dataset, split, source, text, label); record_id is the order of arrival.  Datasets in `SHIPPED` keep
the splits they came with, the others are split anew.  Defined results: null text counts as ''; null split as ''; ties are
broken by record_id; rows given twice are duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import SPARK
from ..functions.text import nfc, preprocess
from .noise import spread

#: Datasets whose own splits are used
SHIPPED = ("sentnob",)
SPLIT_SEED, TRAIN_SHARE, VAL_SHARE = 42, 0.7, 0.1
LEAST_CLUSTERS = 3


def preprocessed(df: DataFrame, text: str = "text", out: str = "clean_text") -> DataFrame:
    """NFC, links, mentions, white space."""
    base = spread(df).withColumn("_t", nfc(F.coalesce(F.col(text), F.lit(""))))
    return base.withColumn(out, F.expr(preprocess(SPARK, "_t"))).drop("_t")


def row_id(dataset: Column, split: Column, text: Column) -> Column:
    """F4."""
    return F.concat(dataset, F.lit("-"), F.substring(F.sha1(F.concat(dataset, F.lit("\0"), split, F.lit("\0"), text)), 1, 16))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`, with the number of rows the key had.

    An aggregate, so a key that a third of all rows share is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"), F.count("*").alias("n_copies"))
    return first.select(*keys, "_r.*", "n_copies")


def cleaned_all(records: DataFrame, *carry: str) -> DataFrame:
    """F1 to F9 with verdict per distinct text: '' kept, 'short', 'non_bengali'; n_copies rows had the text.

    The key of a text is 96 bits of it, so what is shuffled is narrow; clean_text travels only if it is among `carry`."""
    df = records.select("record_id", "dataset", F.coalesce("split", F.lit("")).alias("src_split"), "source", "text", "label")
    df = preprocessed(df).drop("text")
    df = df.withColumn("key_split", F.when(F.col("dataset").isin(*SHIPPED), F.col("src_split")).otherwise(""))
    n = F.expr(SPARK.occurrences("clean_text", maps.CLUSTER))
    bengali = F.regexp_count("clean_text", F.lit("[ঀ-৿]"))
    df = df.withColumns({"n_clusters": n, "_k": F.xxhash64("clean_text"), "_k2": F.hash("clean_text"), "id": row_id(F.col("dataset"), F.col("key_split"), F.col("clean_text"))})
    df = df.withColumn("verdict", F.when(F.col("n_clusters") < LEAST_CLUSTERS, "short").when(bengali == 0, "non_bengali").otherwise(""))
    df = df.select("dataset", "key_split", "_k", "_k2", "record_id", "id", "label", "src_split", "source", "n_clusters", "verdict", *carry)
    return keep_first(df, ["dataset", "key_split", "_k", "_k2"], "record_id").drop("_k", "_k2")


def cross_split_warning(records: DataFrame) -> DataFrame:
    """by dataset, rows whose cleaned text another split of the dataset has as well, all copies counted."""
    df = preprocessed(records.where("split is not null").select("dataset", "split", "text"))
    per = df.select("dataset", "split", F.xxhash64("clean_text").alias("k"), F.hash("clean_text").alias("k2")).groupBy("dataset", "k", "k2").agg(F.count("*").alias("n"), F.size(F.collect_set("split")).alias("s"))
    return per.groupBy("dataset").agg(F.sum(F.when(F.col("s") > 1, F.col("n")).otherwise(0)).alias("n_rows_recurring"))


def prep_stats(records: DataFrame) -> DataFrame:
    """counts of each cleaning step by dataset."""
    return cleaned_all(records).groupBy("dataset").agg(
        F.sum("n_copies").alias("n_raw"),
        F.sum(F.col("n_copies") - 1).alias("dupes_removed"),
        F.count_if(F.col("verdict") == "short").alias("short_removed"),
        F.count_if(F.col("verdict") == "non_bengali").alias("non_bengali_removed"),
        F.count_if(F.col("verdict") == "").alias("n_final"),
    )


def with_splits(cleaned: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Shipped splits (rows without one dropped), else a seeded split stratified by label.

    The order within a label is a hash of seed and id, so the split depends on neither input order nor partitioning;
    cuts are at round-half-even of 70 and 10 percent.  The rows are read twice: persist or write them before.
    """
    shipped = cleaned.where(F.col("dataset").isin(*SHIPPED) & F.col("src_split").isin("train", "val", "test")).withColumn("final_split", F.col("src_split"))
    rest = cleaned.where(~F.col("dataset").isin(*SHIPPED) & F.col("label").isNotNull())
    h = F.sha2(F.concat(F.lit(f"{seed}\x1f"), F.col("id")), 256)
    return shipped.unionByName(_ranked(rest.withColumn("_h", h)).drop("_h", "_rank", "_n"))


def _ranked(df: DataFrame) -> DataFrame:
    """Split by rank of _h within (dataset, label): buckets of the hash are counted first, so no label is sorted in one task."""
    bucket = F.substring("_h", 1, 2)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("dataset", "label", "_b").agg(F.count("*").alias("_c"))  # at most 256 rows a label
    w = Window.partitionBy("dataset", "label")
    before = sizes.withColumn("_before", F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.sum("_c").over(w))
    df = df.join(F.broadcast(before.drop("_c")), ["dataset", "label", "_b"])  # 256 rows a label of a dataset at most
    rank = F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy("dataset", "label", "_b").orderBy("_h")) - 1
    df = df.withColumn("_rank", rank)
    train = F.bround(F.col("_n") * F.lit(TRAIN_SHARE), 0)
    val = F.bround(F.col("_n") * F.lit(VAL_SHARE), 0)
    split = F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + val, "val").otherwise("test")
    return df.withColumn("final_split", split).drop("_b", "_before")


def cross_split_duplicates(records: DataFrame, text: str = "text") -> DataFrame:
    """For each dataset and pair of splits a|b (a < b) the number of texts that both have; pairs without any are 0."""
    df = records.where("split is not null").select("dataset", "split", F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), F.hash(F.coalesce(text, F.lit(""))).alias("k2"))
    sets = df.groupBy("dataset", "k", "k2").agg(F.collect_set("split").alias("s"))  # at most the number of splits
    pairs = [("test", "train"), ("test", "val"), ("train", "val")]
    both = [F.struct(F.lit(f"{a}|{b}").alias("split_pair"), (F.array_contains("s", a) & F.array_contains("s", b)).cast("int").alias("n")) for a, b in pairs]
    return sets.select("dataset", F.inline(F.array(*both))).groupBy("dataset", "split_pair").agg(F.sum("n").alias("n_identical_texts"))


def leakage(records: DataFrame, text: str = "text") -> DataFrame:
    """By dataset, rows of one split whose text another split has, and their share in percent."""
    df = records.where("split is not null").select("dataset", "split", F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), F.hash(F.coalesce(text, F.lit(""))).alias("k2"))
    per = df.groupBy("dataset", "k", "k2").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    held = lambda a, b: F.sum(F.when(F.col(b) > 0, F.col(a)).otherwise(0))
    out = per.groupBy("dataset").agg(
        held("test", "train").alias("test_in_train"), held("val", "train").alias("val_in_train"), held("val", "test").alias("val_in_test"),
        F.sum("test").alias("n_test"), F.sum("val").alias("n_val"),
    )
    pct = lambda a, n: F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(n)), F.lit(0.0)), 3)
    return out.select("dataset", "test_in_train", "val_in_train", "val_in_test", pct("test_in_train", "n_test").alias("pct_test_in_train"), pct("val_in_train", "n_val").alias("pct_val_in_train"), pct("val_in_test", "n_val").alias("pct_val_in_test"))


def sample(df: DataFrame, key: str, k: int, seed: int | str, by: str | None = None) -> DataFrame:
    """K rows by least hash of seed and key, of all rows or of each group; one pass, mergeable, order-free."""
    h = F.sha2(F.concat(F.lit(f"{seed}\x1f"), F.col(key).cast("string")), 256)
    if by is None:
        return df.withColumn("_h", h).orderBy("_h").limit(k).drop("_h")
    # each task keeps k candidates a group before anything is gathered
    part = df.withColumn("_h", h).withColumn("_p", F.spark_partition_id())
    local = part.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy("_h"))).where(F.col("_r") <= k)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h"))).where(F.col("_r") <= k).drop("_h", "_r", "_p")
