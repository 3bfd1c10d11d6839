"""Neighbouring keys of a keyboard layout, as a join of key positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Offset of each row of keys, the key that stands for none, reach of a neighbour
STAGGER = (0.0, 0.5, 1.5)
NO_KEY = "-"
REACH = 1.01


def adjacency(spark: SparkSession, normal: list[str], shift: list[str] | None = None, diagonals: bool = True) -> DataFrame:
    """key, neighbours (sorted): keys of one layer at most about one apart in their row or, if wanted, in the next.

    Layers are joined one by one, so a shifted key neighbours shifted keys only; a key that both layers have has the neighbours of
    both.  Keys of several code points may be neighbours but have no row of their own.  A layout has some tens of keys."""
    rows = [(n, k, r, STAGGER[min(r, 2)] + x) for n, layer in enumerate((normal, shift or [])) for r, keys in enumerate(layer) for x, k in enumerate(keys) if k and k != NO_KEY]
    p = spark.createDataFrame(rows, "layer int, key string, row int, x double").coalesce(1)
    # the last place counts for a key that one layer has twice
    p = p.groupBy("layer", "key").agg(F.max_by(F.struct("row", "x"), F.struct("row", "x")).alias("p")).select("layer", "key", "p.row", "p.x")
    a, b = p.alias("a"), F.broadcast(p).alias("b")
    near = (F.abs(F.col("a.x") - F.col("b.x")) <= REACH) & (F.abs(F.col("a.row") - F.col("b.row")) <= (1 if diagonals else 0)) & (F.col("a.key") != F.col("b.key")) & (F.col("a.layer") == F.col("b.layer"))
    return a.join(b, near).where(F.length("a.key") == 1).groupBy(F.col("a.key").alias("key")).agg(F.array_sort(F.collect_set("b.key")).alias("neighbours"))
