"""Evaluation of predictions: per-class and summary metrics, paired tests, over any number of cells at once.

A cell is a run at a severity and noise type.  Predictions given twice count once (the lesser prediction stands); null
predictions are left out.  All metrics come from confusion counts, so nothing larger than classes squared a cell
is gathered.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = ["run_id", "severity", "noise_type"]


def clean_predictions(preds: DataFrame) -> DataFrame:
    """One row for each cell and id, with the run's parts; clean cells have noise type ''."""
    p = preds.select("run_id", "severity", F.coalesce("noise_type", F.lit("")).alias("noise_type"), "id", "y_true", "y_pred").where("y_pred is not null and y_true is not null")
    one = p.groupBy(*CELL, "id").agg(F.min("y_true").alias("y_true"), F.min("y_pred").alias("y_pred"))
    part = lambda k: F.split_part("run_id", F.lit("__"), F.lit(k))
    return one.withColumns({"model": part(1), "task": part(2), "seed": part(3).cast("int"), "train_variant": part(4)})


def confusion(preds: DataFrame, *cell: str) -> DataFrame:
    return preds.groupBy(*cell, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(preds: DataFrame, *cell: str) -> DataFrame:
    """M1: precision, recall, f1, support, predicted of every class that occurs as true or predicted."""
    return per_class_of(confusion(preds, *cell), *cell)


def per_class_of(c: DataFrame, *cell: str) -> DataFrame:
    """per_class from confusion counts, in any parts."""
    z = F.lit(0).cast("long")
    rows = c.select(*cell, F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), z.alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(z).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), z.alias("support"), F.col("n").alias("predicted"), z.alias("tp")),
    )))
    s = rows.groupBy(*cell, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    s = s.withColumns({"precision": F.coalesce(F.try_divide("tp", "predicted"), zero), "recall": F.coalesce(F.try_divide("tp", "support"), zero)})
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero)
    return s.withColumn("f1", f1)


def summary(preds: DataFrame, *cell: str) -> DataFrame:
    """M2 to M4, M6 by cell."""
    return summary_of(confusion(preds, *cell), *cell)


def summary_of(counts: DataFrame, *cell: str) -> DataFrame:
    """summary from confusion counts, in any parts."""
    k = per_class_of(counts, *cell)
    s, c = F.sum("support").cast("double"), F.sum("tp").cast("double")
    pt, pp, tt = (F.sum(F.col(a).cast("double") * F.col(b)) for a, b in (("predicted", "support"), ("predicted", "predicted"), ("support", "support")))
    mcc = F.coalesce(F.try_divide(c * s - pt, F.sqrt((s * s - pp) * (s * s - tt))), F.lit(0.0))
    return k.groupBy(*cell).agg(
        s.cast("long").alias("n_test_items"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / s).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), (c / s).alias("accuracy"), mcc.alias("mcc"),
    )


def runs(preds: DataFrame) -> DataFrame:
    """The result table: one row a cell, with the parts of the run."""
    return summary(clean_predictions(preds), *CELL, "model", "task", "seed", "train_variant")


def pr_auc(scored: DataFrame, *cell: str, score: str = "score", positive: str = "positive") -> DataFrame:
    """M5: average precision, ties of the score in one step; computed over distinct scores."""
    ties = scored.groupBy(*cell, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    w = Window.partitionBy(*cell).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    up = ties.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("p").over(w)})
    return up.groupBy(*cell).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("cp") / F.col("cn")), F.sum("p")), F.lit(0.0)).alias("pr_auc"))


def paired(preds: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Predictions of two models for the same task, seed, variant, severity, noise type and id."""
    keys = ["task", "seed", "train_variant", "severity", "noise_type", "id"]
    p = clean_predictions(preds)
    side = lambda m, x: p.where(F.col("model") == m).select(*keys, F.col("y_true").alias(f"y_true_{x}"), F.col("y_pred").alias(f"y_pred_{x}"))
    return side(model_a, "a").join(side(model_b, "b"), keys)


def join_check(preds: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """J1's assertion: rows of either model, of the join, and rows whose gold labels disagree."""
    p = clean_predictions(preds)
    n = lambda m: p.where(F.col("model") == m).agg(F.count("*").alias("n"))
    j = paired(preds, model_a, model_b).agg(F.count("*").alias("n_joined"), F.count_if(F.col("y_true_a") != F.col("y_true_b")).alias("n_gold_differs"))
    return n(model_a).withColumnRenamed("n", "n_a").crossJoin(n(model_b).withColumnRenamed("n", "n_b")).crossJoin(j)  # one row each


def mcnemar_cells(pairs: DataFrame, *by: str) -> DataFrame:
    """M7: both right, only a, only b, neither."""
    a, b = F.col("y_pred_a") == F.col("y_true_a"), F.col("y_pred_b") == F.col("y_true_b")
    return pairs.groupBy(*by).agg(F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


@F.pandas_udf(T.DoubleType())
def _p_value(b: pd.Series, c: pd.Series) -> pd.Series:
    def p(x: int, y: int) -> float:
        n = x + y
        if n == 0 or x == y and n < 25:
            return 1.0
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(x, y) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / n / 2))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


def mcnemar(cells: DataFrame) -> DataFrame:
    """M8: method, statistic (null where exact), odds ratio, winner; p_value by the one function Spark lacks."""
    n = F.col("only_a") + F.col("only_b")
    stat = F.when(n >= 25, F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, 2) / n)
    return cells.withColumns({
        "method": F.when(n >= 25, "chi2").otherwise("exact"), "statistic": stat,
        "odds_ratio": (F.col("only_a") + 0.5) / (F.col("only_b") + 0.5),
        "winner": F.when(F.col("only_a") > F.col("only_b"), "a").when(F.col("only_a") < F.col("only_b"), "b").otherwise("tie"),
        "p_value": _p_value("only_a", "only_b"),
    })


def holm(tests: DataFrame, p: Column | str = "p_value", *family: str) -> DataFrame:
    """Step-down adjusted p within a family of tests (few rows): running maximum of (m - rank) p, at most 1."""
    w = Window.partitionBy(*family).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family))
    raw = tests.withColumn("_x", (m - F.row_number().over(w) + 1) * (F.col(p) if isinstance(p, str) else p))
    out = raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out.drop("_x").withColumn("significant", F.col("p_holm") < 0.05)


def significance(pairs: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """M9: tests per task, severity and seed, and pooled: discordant counts summed and accuracies averaged over the seeds
    there are, adjusted p within the family.  With `extra` = noise_type the tests of M10, each type a family of its own."""
    cells = mcnemar_cells(pairs.where("severity > 0"), "task", "severity", "seed", *extra)
    n = F.col("both_right") + F.col("only_a") + F.col("only_b") + F.col("neither")
    seeded = mcnemar(cells).withColumns({"n_items": n, "acc_a": (F.col("both_right") + F.col("only_a")) / n, "acc_b": (F.col("both_right") + F.col("only_b")) / n})
    seeded = seeded.withColumn("acc_diff", (F.col("only_a") - F.col("only_b")) / F.col("n_items"))
    summed = seeded.groupBy("task", "severity", *extra).agg(
        F.count("*").alias("seeds"), F.sum("n_items").alias("n_items"), F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"),
        F.avg("acc_a").alias("acc_a"), F.avg("acc_b").alias("acc_b"), F.avg("acc_diff").alias("acc_diff"),
    )
    return seeded, holm(mcnemar(summed), "p_value", *extra)


def pooled_test(pairs: DataFrame) -> DataFrame:
    """Seeds and cells of a task and severity pooled before the test."""
    return holm(mcnemar(mcnemar_cells(pairs.where("severity > 0"), "task", "severity")))
