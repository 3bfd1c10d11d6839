"""Tables over runs (one row a cell): baselines, curves, robustness, rankings, grids, packing.

`runs` has task, model, train_variant, seed, noise_type ('' where clean), severity and metrics; its size is that of the
experiment, not of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maps


def _sd(c: str):
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def clean_baseline(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """R2."""
    return runs.where("severity = 0").groupBy("task", "model").agg(F.avg(metric).alias("mean"), _sd(metric).alias("std"), F.count("*").alias("count"))


def noise_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, g) for g, xs in maps.NOISE_GROUPS.items() for x in xs], "noise_type string, noise_group string")


def curve_table(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean and deviation by task, model, type and severity, the clean baseline standing at severity 0 of every type."""
    noisy = runs.where("severity > 0").groupBy("task", "model", "noise_type", "severity").agg(F.avg(metric).alias("mean"), _sd(metric).alias("std"))
    base = clean_baseline(runs, metric).drop("count").crossJoin(F.broadcast(noise_types(runs.sparkSession).select("noise_type")))  # nine types
    return noisy.unionByName(base.withColumn("severity", F.lit(0)))


def robustness(runs: DataFrame, severity: int = 5, metric: str = "macro_f1") -> DataFrame:
    """R4, J2."""
    s = runs.where(F.col("severity") == severity).groupBy("task", "model", "noise_type").agg(F.avg(metric).alias("f1_s5"))
    base = clean_baseline(runs, metric).select("task", "model", F.col("mean").alias("clean_f1"))
    return s.join(base, ["task", "model"]).withColumns({"abs_drop": F.col("clean_f1") - F.col("f1_s5"), "retention": F.try_divide("f1_s5", "clean_f1")})


def normalizer_delta(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Paired difference of normalizer on and off by model."""
    wide = runs.groupBy("model", "noise_type", "severity", "seed").pivot("normalizer", ["on", "off"]).agg(F.avg(metric))
    d = wide.where("`on` is not null and off is not null").withColumn("d", F.col("on") - F.col("off"))
    return d.groupBy("model").agg(F.avg("d").alias("mean_delta"), _sd("d").alias("sd_delta"), F.max(F.abs("d")).alias("max_abs"), F.count("*").alias("n"))


def degradation(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Pooled over types and seeds, by metric, task, model and severity."""
    long = runs.select("task", "model", "severity", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))))
    return long.groupBy("metric", "task", "model", "severity").agg(F.avg("v").alias("mean"), _sd("v").alias("std"), F.count("*").alias("count"))


def relative_degradation(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean over the clean mean; tasks and models whose clean mean is 0 or missing are left out."""
    m = runs.groupBy("task", "model", "severity").agg(F.avg(metric).alias("mean"))
    clean = F.max(F.when(F.col("severity") == 0, F.col("mean"))).over(Window.partitionBy("task", "model"))
    return m.withColumn("clean", clean).where("clean > 0").withColumn("relative", F.col("mean") / F.col("clean"))


def heatmap(runs: DataFrame, severity: int = 3, metric: str = "accuracy") -> DataFrame:
    """Mean over tasks of the loss against clean, types by models."""
    base = runs.where("severity = 0").groupBy("task", "model").agg(F.avg(metric).alias("c"))
    at = runs.where(F.col("severity") == severity).groupBy("task", "model", "noise_type").agg(F.avg(metric).alias("v"))
    return at.join(base, ["task", "model"]).groupBy("noise_type", "model").agg(F.avg(F.col("c") - F.col("v")).alias("loss"))


def augmentation_match(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """R11 by model, condition and severity: means of the group means of augmented runs, on the noise group they were
    trained with (matched) or on the other (mismatched), next to those of clean runs on the same groups.

    A group counts where it has a value; rows need an augmented and a baseline value.  Types of other groups are left out."""
    pairs = [("matched", "augmented_n1n4", "A"), ("matched", "augmented_n5n8", "B"), ("mismatched", "augmented_n1n4", "B"), ("mismatched", "augmented_n5n8", "A")]
    spark = runs.sparkSession
    cells = F.broadcast(spark.createDataFrame(pairs, "condition string, variant string, noise_group string"))  # four rows
    g = runs.where("severity > 0").join(F.broadcast(noise_types(spark)), "noise_type").groupBy("model", "train_variant", "noise_group", "severity").agg(F.avg(metric).alias("m"))
    aug = g.join(cells, ["noise_group"]).where("train_variant = variant").groupBy("model", "condition", "severity").agg(F.avg("m").alias(f"augmented_{metric}"))
    base = g.where("train_variant = 'clean'").join(cells, "noise_group").groupBy("model", "condition", "severity").agg(F.avg("m").alias(f"baseline_{metric}"))
    return aug.join(base, ["model", "condition", "severity"])


def rank_inversion(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Rank of models within a task on clean and on noisy text."""
    m = runs.groupBy("task", "model").agg(F.avg(F.when(F.col("severity") == 0, F.col(metric))).alias("clean"), F.avg(F.when(F.col("severity") > 0, F.col(metric))).alias("noisy"))
    rank = lambda c: F.rank().over(Window.partitionBy("task").orderBy(F.desc(c)))
    return m.where("clean is not null and noisy is not null").withColumns({"rank_clean": rank("clean"), "rank_noisy": rank("noisy")})


def noise_slopes(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Spec-only: mean over noisy cells, least-squares slope on severity and rank correlation of both, by task and model."""
    w = Window.partitionBy("task", "model")
    # ranks of ties are averaged
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("task", "model", c)) - 1) / 2
    r = runs.select("task", "model", "severity", F.col(metric).alias("m"), rank("severity").alias("rs"), rank(metric).alias("rm"))
    return r.groupBy("task", "model").agg(
        F.avg(F.when(F.col("severity") > 0, F.col("m"))).alias("mean_noise"), F.regr_slope("m", F.col("severity")).alias("slope"), F.corr("rs", "rm").alias("spearman"),
    )


def best_models(runs: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """W8."""
    return clean_baseline(runs, metric).groupBy("task").agg(F.max_by("model", F.struct("mean", "model")).alias("best_model"), F.max("mean").alias("best"))


def prediction_collapse(per_class: DataFrame) -> DataFrame:
    """Share of items predicted as each class, from recall, support and precision; precision 0 counts 0."""
    rate = F.coalesce(F.try_divide(F.col("recall") * F.col("support"), F.when(F.col("precision") > 0, F.col("precision"))), F.lit(0.0))
    total = F.sum("support").over(Window.partitionBy("run_id", "severity", "noise_type"))
    p = per_class.withColumn("rate", rate / total)
    return p.groupBy("task", "model", "noise_type", "severity", "label").agg(F.avg("rate").alias("mean_rate"))


def integrity(runs: DataFrame) -> DataFrame:
    """Runs, cells, repeated cells, null metrics, and whether every noisy severity has as many cells."""
    cells = runs.groupBy("run_id", "severity", "noise_type").agg(F.count("*").alias("n"), F.count_if(F.col("macro_f1").isNull()).alias("nulls"))
    a = cells.agg(F.countDistinct("run_id").alias("n_runs"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("nulls").alias("n_null_metric"))
    per = cells.where("severity > 0").groupBy("severity").agg(F.count("*").alias("c")).agg((F.min("c") == F.max("c")).alias("even_severities"))
    return a.crossJoin(per)  # one row each


def grid(spark: SparkSession, models: list[str], tasks: list[str], seeds: list[int], variants: list[str], severities: list[int]) -> DataFrame:
    """All cells of an experiment, the clean one of each run included."""
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    jobs = spark.range(1).select(each(models).alias("model")).select("*", each(tasks).alias("task")).select("*", each(seeds).alias("seed")).select("*", each(variants).alias("train_variant"))
    cells = [F.struct(F.lit(t).alias("noise_type"), F.lit(s).alias("severity")) for t, s in [("", 0), *((t, s) for t in maps.NOISE_TYPES for s in severities)]]
    return jobs.select("*", F.inline(F.array(*cells))).withColumn("run_id", F.concat_ws("__", "model", "task", F.col("seed").cast("string"), "train_variant"))


def missing_cells(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells that no row has yet."""
    return expected.join(runs.select("run_id", "severity", "noise_type"), ["run_id", "severity", "noise_type"], "left_anti")


def cer_vs_drop(cer: DataFrame, runs: DataFrame) -> DataFrame:
    """Error rate of each type and severity next to the loss of accuracy pooled over runs."""
    long = cer.where("`group` = 'ALL'").select("noise_type", F.inline(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(f"s{s}").alias("cer")) for s in range(1, 6)))))
    acc = runs.where("severity > 0").groupBy("noise_type", "severity").agg(F.avg("accuracy").alias("acc"))
    clean = runs.where("severity = 0").agg(F.avg("accuracy").alias("clean_acc"))
    return long.join(acc, ["noise_type", "severity"]).crossJoin(clean).withColumn("drop", F.col("clean_acc") - F.col("acc"))  # clean is one row


# Examples a second of training and inference, on a GPU and for the n-gram classifier, and the share of
# an epoch that its validation takes; tasks whose cells run with the normaliser on and off
TRAIN_RATE, INFER_RATE, CLASSICAL_TRAIN_RATE, CLASSICAL_INFER_RATE, VALIDATION = 65.0, 200.0, 4000.0, 20000.0, 0.20
DOUBLED_TASKS = ("banfakenews",)


def job_costs(jobs: DataFrame, epochs: int = 4, cells: int = 45, classical: tuple[str, ...] = ("char_ngram",), doubled: tuple[str, ...] = DOUBLED_TASKS) -> DataFrame:
    """R16 from model, task, n_train and n_test: seconds of training and of the grid; hours of GPU, 0 for classical jobs."""
    plain = F.col("model").isin(*classical)
    predictions = F.col("n_test") * (F.when(F.col("task").isin(*doubled), 2 * cells).otherwise(cells) + 1)
    train = F.when(plain, F.col("n_train") / CLASSICAL_TRAIN_RATE).otherwise(F.col("n_train") / TRAIN_RATE * (1 + VALIDATION) * epochs)
    grid_s = F.when(plain, predictions / CLASSICAL_INFER_RATE).otherwise(predictions / INFER_RATE)
    out = jobs.withColumns({"train_seconds": train, "grid_seconds": grid_s})
    return out.withColumn("gpu_h", F.when(plain, 0.0).otherwise((F.col("train_seconds") + F.col("grid_seconds")) / 3600))


def class_percent(composition: DataFrame, by: str = "dataset") -> DataFrame:
    """One column a character class, percent of the group's characters; classes that are missing are 0."""
    wide = composition.groupBy(by).pivot("char_class", maps.CHAR_CLASSES).agg(F.sum("n"))
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in maps.CHAR_CLASSES}
    total = sum(filled.values(), F.lit(0))
    return wide.select(by, *(F.coalesce(F.try_divide(F.lit(100.0) * x, total), F.lit(0.0)).alias(c) for c, x in filled.items()))


def bars(quality: DataFrame, emoji: DataFrame, by: str = "dataset") -> DataFrame:
    """Percent of rows with U+FFFD and of rows with an emoji by group (inventory and emoji rates of the same groups)."""
    q = quality.groupBy(by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_replacement_char").alias("n_lost"))
    e = emoji.groupBy(by).agg(F.sum("n_rows").alias("n"), F.sum("n_bearing").alias("n_bearing"))
    pct = lambda a, b: F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), F.lit(0.0))
    return q.join(e, by).select(by, pct("n_lost", "n_rows").alias("pct_replacement"), pct("n_bearing", "n").alias("pct_emoji"))


def model_table(spark: SparkSession, models: list[tuple]) -> DataFrame:
    """The registry of models as a table in its order: name, kind, checkpoint, parameters, languages, normaliser."""
    rows = [(i, *m) for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "position int, model string, kind string, checkpoint string, parameters_m double, languages string, normalizer boolean")


def pack_sessions(jobs: DataFrame, session_h: float = 11.0, week_h: float = 30.0) -> DataFrame:
    """Jobs by falling hours into the first session with room, sessions in order into weeks; jobs are the
    experiment's (tens to hundreds of rows), folded in one array."""
    arr = F.array_sort(F.collect_list(F.struct((-F.col("gpu_h")).alias("k"), F.col("run_id"), F.col("gpu_h"))))
    start = F.array().cast("array<struct<total:double,runs:array<string>>>")

    def add(acc, j):
        fits = F.transform(acc, lambda s: s["total"] + j["gpu_h"] <= session_h + 1e-9)
        at = F.array_position(fits, True)
        new = F.struct((F.lit(0.0) + j["gpu_h"]).alias("total"), F.array(j["run_id"]).alias("runs"))
        put = F.transform(acc, lambda s, i: F.when(i == at - 1, F.struct((s["total"] + j["gpu_h"]).alias("total"), F.concat(s["runs"], F.array(j["run_id"])).alias("runs"))).otherwise(s))
        return F.when(at > 0, put).otherwise(F.concat(acc, F.array(new)))

    sessions = jobs.agg(F.aggregate(arr, start, add).alias("s")).select(F.posexplode("s").alias("session", "s")).select("session", "s.total", "s.runs")
    ordered = sessions.agg(F.array_sort(F.collect_list(F.struct("session", "total", "runs"))).alias("a"))
    # weeks fill in order: a session that no longer fits opens the next
    first = F.struct(F.lit(0).alias("week"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("weeks"))

    def week(acc, s):
        fits = acc["used"] + s["total"] <= week_h + 1e-9
        w = F.when(fits, acc["week"]).otherwise(acc["week"] + 1)
        return F.struct(w.alias("week"), F.when(fits, acc["used"] + s["total"]).otherwise(s["total"]).alias("used"), F.concat(acc["weeks"], F.array(w)).alias("weeks"))

    weeks = ordered.select("a", F.aggregate("a", first, week)["weeks"].alias("w"))
    return weeks.select(F.inline(F.arrays_zip("a", "w"))).select("a.session", F.col("w").alias("week"), F.explode("a.runs").alias("run_id"), F.round("a.total", 6).alias("session_h"))
