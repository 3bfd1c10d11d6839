"""Sinks: final splits with manifest, append-only results, prediction files, resumable stages.

Defined results: appending keys that are there already adds nothing; a repeated key inside one batch is written once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT_KEY = ["run_id", "normalizer", "noise_type", "severity"]


def write_splits(df: DataFrame, path: str, split: str = "final_split") -> None:
    """Id, text, label by dataset and split, sorted by id within files."""
    df.repartition("dataset", split).sortWithinPartitions("dataset", split, "id").write.mode("overwrite").partitionBy("dataset", split).parquet(path)


def manifest(df: DataFrame, split: str = "final_split") -> DataFrame:
    """Rows of each split and a digest of its ids that depends on no order."""
    return df.groupBy("dataset", split).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha1("id"), 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("ids_digest"))


def write_manifest(df: DataFrame, path: str, seed: int, sources: dict[str, str], leakage: DataFrame | None = None) -> dict:
    """The manifest as a JSON file: seed, digests of the source files, rows and ids of each split, leakage.

    What the driver gathers is a row a dataset and split."""
    splits = [r.asDict() for r in manifest(df).orderBy("dataset", "final_split").collect()]
    found = [r.asDict() for r in leakage.orderBy("dataset").collect()] if leakage is not None else None
    out = {"seed": seed, "sources": sources, "splits": splits, "leakage": found}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=1, sort_keys=True)
    return out


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table as markdown, in the order of its rows."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[show(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def write_table(df: DataFrame, path: str, digits: dict[str, int] | None = None, order: list[str] | None = None) -> None:
    """A result table as one CSV file with a header, sorted, columns of `digits` with that many decimals."""
    shown = [F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{digits[c]}f", F.col(c).cast("double"))).alias(c) if digits and c in digits else F.col(c) for c in df.columns]
    out = df.orderBy(*order) if order else df
    out.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_results(batch: DataFrame, path: str, key: list[str] = RESULT_KEY) -> None:
    """Rows whose key the table lacks, null noise types counting as 'none'."""
    spark = batch.sparkSession
    keyed = batch.fillna("none", ["noise_type"]) if "noise_type" in key else batch
    new = keyed.dropDuplicates(key)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """One directory a run, severity and normalizer; a rerun replaces its own directories only."""
    preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "severity", "normalizer").parquet(path)


def last_curves(curves: DataFrame, seq: str = "seq") -> DataFrame:
    """The last row of each run and epoch in order of arrival."""
    rest = [c for c in curves.columns if c not in ("run_id", "epoch")]
    return curves.groupBy("run_id", "epoch").agg(F.max_by(F.struct(*rest), seq).alias("r")).select("run_id", "epoch", "r.*")


def training_curves(curves: DataFrame, metric: str = "val_macro_f1") -> DataFrame:
    """Means by task, model and epoch."""
    return last_curves(curves).groupBy("task", "model", "epoch").agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def boxplot(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Quartiles and range of each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"), F.count(value).alias("n"))


def latex_table(rows: DataFrame, index: str, column: str, value: str, digits: int = 3) -> str:
    """A small table, the best of each row in bold (formats at the edge only; rows are those of the experiment)."""
    cells = {(r[index], r[column]): r[value] for r in rows.select(index, column, value).collect()}
    names = sorted({c for _, c in cells})
    lines = [" & ".join(["", *names]) + r" \\"]
    for i in sorted({i for i, _ in cells}):
        own = [cells.get((i, c)) for c in names]
        best = max(v for v in own if v is not None)
        shown = ["--" if v is None else (rf"\textbf{{{v:.{digits}f}}}" if v == best else f"{v:.{digits}f}") for v in own]
        lines.append(" & ".join([str(i), *shown]) + r" \\")
    return "\n".join(lines)


def latex_rows(df: DataFrame, columns: list[str], formats: dict[str, str], order: list[str], bold: str | None = None, within: str | None = None) -> str:
    """One line a row, numbers by format, the greatest value of `bold` in each group of `within` in bold."""
    rows = df.orderBy(*order).collect()
    best: dict = {}
    for r in rows:
        if bold and r[bold] is not None:
            key = r[within] if within else None
            best[key] = max(best.get(key, r[bold]), r[bold])
    lines = []
    for r in rows:
        cells = []
        for c in columns:
            v = "--" if r[c] is None else format(r[c], formats[c]) if c in formats else str(r[c]).replace("_", r"\_")
            cells.append(rf"\textbf{{{v}}}" if c == bold and r[c] is not None and r[c] == best[r[within] if within else None] else v)
        lines.append(" & ".join(cells) + r" \\")
    return "\n".join(lines)


def clean_latex(baseline: DataFrame) -> str:
    """S14 of R2: means and deviations by task, the best model in bold."""
    return latex_rows(baseline, ["task", "model", "mean", "std", "count"], {"mean": ".3f", "std": ".3f"}, ["task", "model"], "mean", "task")


def retention_latex(robustness: DataFrame) -> str:
    """S14 of R4: mean retention by task and model over noise types."""
    by = robustness.groupBy("task", "model").agg(F.avg("retention").alias("retention"), F.avg("abs_drop").alias("abs_drop"))
    return latex_rows(by, ["task", "model", "retention", "abs_drop"], {"retention": ".3f", "abs_drop": ".3f"}, ["task", "model"], "retention", "task")


def normalizer_latex(delta: DataFrame) -> str:
    """S14 of R5."""
    return latex_rows(delta, ["model", "mean_delta", "sd_delta", "max_abs", "n"], {"mean_delta": "+.4f", "sd_delta": ".4f", "max_abs": ".4f"}, ["model"])


def mcnemar_latex(tests: DataFrame) -> str:
    """S14 of M9."""
    return latex_rows(tests, ["task", "severity", "only_a", "only_b", "odds_ratio", "p_holm", "winner"], {"odds_ratio": ".2f", "p_holm": ".2e"}, ["task", "severity"])


def smoke_path(path: str, limit: int | None, root: str = ".") -> str:
    """Limited runs write below .smoke so that they never mix with whole ones."""
    return os.path.join(root, ".smoke", os.path.relpath(path, root)) if limit else path


def should_run(marker: str, meta: str, limit: int | None, force: bool = False) -> bool:
    """Run unless the marker exists with metadata that name a whole run; a marker without metadata proves nothing."""
    if force or limit or not os.path.exists(marker) or not os.path.exists(meta):
        return True
    with open(meta) as f:
        return json.load(f).get("limited") is not False


def run_stages(names: str, stages: dict[str, Callable[[], int]]) -> int:
    """The stages named (comma list or all) in their order; the first that fails ends the run."""
    wanted = list(stages) if names == "all" else names.split(",")
    unknown = [n for n in wanted if n not in stages]
    if unknown:
        raise ValueError(f"unknown stages {unknown}; there are {list(stages)}")
    for n in wanted:
        code = stages[n]()
        if code:
            return code
    return 0


def ingest_sequence(df: DataFrame, order: str) -> DataFrame:
    """An explicit order of arrival by a stored column (for small tables: one partition sorts them)."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(order)))
