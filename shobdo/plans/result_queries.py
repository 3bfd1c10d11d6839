"""Queries of evaluation and result analytics over preds, and of the noise measures over samples of corpus_records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import DUCK, nested
from ..operators import analysis, evaluate, metrics, noise, prepare, rates
from . import independent
from .noise_queries import records

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _preds(spark, d):
    return spark.read.parquet(f"{d}/preds.parquet")


def _runs(spark, d):
    return evaluate.runs(_preds(spark, d))


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 9) for c in columns})


_P = """p AS (SELECT run_id, severity, coalesce(noise_type, '') AS noise_type, id, min(y_true) AS y_true, min(y_pred) AS y_pred, split_part(run_id, '__', 1) AS model, split_part(run_id, '__', 2) AS task,
  CAST(split_part(run_id, '__', 3) AS INT) AS seed, split_part(run_id, '__', 4) AS train_variant FROM preds WHERE y_pred IS NOT NULL AND y_true IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_K = f"""{_P}, l AS (SELECT DISTINCT run_id, severity, noise_type, model, task, seed, train_variant, unnest([y_true, y_pred]) AS label FROM p),
  k AS (SELECT l.*, (SELECT count(*) FROM p WHERE p.run_id = l.run_id AND p.severity = l.severity AND p.noise_type = l.noise_type AND p.y_true = l.label) AS support,
    (SELECT count(*) FROM p WHERE p.run_id = l.run_id AND p.severity = l.severity AND p.noise_type = l.noise_type AND p.y_pred = l.label) AS predicted,
    (SELECT count(*) FROM p WHERE p.run_id = l.run_id AND p.severity = l.severity AND p.noise_type = l.noise_type AND p.y_pred = l.label AND p.y_true = l.label) AS tp FROM l),
  k2 AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall, 2.0::DOUBLE * tp / (support + predicted) AS f1 FROM k)"""
_R = f"""{_K}, runs AS (SELECT run_id, severity, noise_type, model, task, seed, train_variant, CAST(sum(support) AS BIGINT) AS n_test_items, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
  avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, sum(tp) / sum(support)::DOUBLE AS accuracy,
  coalesce((sum(tp)::DOUBLE * sum(support)::DOUBLE - sum(predicted::DOUBLE * support)) / nullif(sqrt((sum(support)::DOUBLE ^ 2 - sum(predicted::DOUBLE ^ 2)) * (sum(support)::DOUBLE ^ 2 - sum(support::DOUBLE ^ 2))), 0), 0) AS mcc
  FROM k2 GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
_METRICS = ["macro_f1", "weighted_f1", "balanced_accuracy", "accuracy", "mcc"]
_RM = ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS)


@query(f'WITH {_K} SELECT run_id, severity, noise_type, label, support, predicted, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM k2')
def confusion_metrics(spark, d):
    out = evaluate.per_class(evaluate.clean_predictions(_preds(spark, d)), *evaluate.CELL)
    return rounded(out.drop("tp"), "precision", "recall", "f1")


@query(f"WITH {_R} SELECT run_id, severity, noise_type, model, task, seed, train_variant, n_test_items, {_RM} FROM runs")
def run_metrics(spark, d):
    return rounded(_runs(spark, d), *_METRICS)


@query(f"WITH {_R} SELECT task, model, round(avg(macro_f1), 9) AS mean, round(coalesce(stddev_samp(macro_f1), 0), 9) AS std, count(*) AS count FROM runs WHERE severity = 0 GROUP BY 1, 2")
def clean_baseline(spark, d):
    return rounded(analysis.clean_baseline(_runs(spark, d)), "mean", "std")


_TYPES = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in maps.NOISE_TYPES) + "]) AS noise_type)"
_AB = "CASE WHEN noise_type IN (" + ", ".join(f"'{x}'" for x in maps.NOISE_TYPES[:4]) + ") THEN 'A' WHEN noise_type = 'whitespace_error' THEN 'C' ELSE 'B' END"


@query(f"""WITH {_R} SELECT task, model, noise_type, severity, round(avg(macro_f1), 9) AS mean, round(coalesce(stddev_samp(macro_f1), 0), 9) AS std FROM runs WHERE severity > 0 GROUP BY 1, 2, 3, 4
  UNION ALL SELECT task, model, t.noise_type, 0, round(avg(macro_f1), 9), round(coalesce(stddev_samp(macro_f1), 0), 9) FROM runs, {_TYPES} t WHERE severity = 0 GROUP BY 1, 2, 3""")
def curve_table(spark, d):
    return rounded(analysis.curve_table(_runs(spark, d)), "mean", "std")


@query(f"""WITH {_R}, c AS (SELECT task, model, avg(macro_f1) AS clean_f1 FROM runs WHERE severity = 0 GROUP BY 1, 2), s AS (SELECT task, model, noise_type, avg(macro_f1) AS f1_s5 FROM runs WHERE severity = 5 GROUP BY 1, 2, 3)
  SELECT task, model, noise_type, round(f1_s5, 9) AS f1_s5, round(clean_f1, 9) AS clean_f1, round(clean_f1 - f1_s5, 9) AS abs_drop, round(f1_s5 / nullif(clean_f1, 0), 9) AS retention FROM s JOIN c USING (task, model)""")
def robustness_s5(spark, d):
    return rounded(analysis.robustness(_runs(spark, d)), "f1_s5", "clean_f1", "abs_drop", "retention")


@query(f"WITH {_R} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, task, model, severity, round(avg({m}), 9) AS mean, round(coalesce(stddev_samp({m}), 0), 9) AS std, count(*) AS count FROM runs GROUP BY 1, 2, 3, 4" for m in ("macro_f1", "accuracy")))
def degradation_curve(spark, d):
    return rounded(analysis.degradation(_runs(spark, d), ["macro_f1", "accuracy"]), "mean", "std")


@query(f"""WITH {_R}, m AS (SELECT task, model, severity, avg(macro_f1) AS mean FROM runs GROUP BY 1, 2, 3), c AS (SELECT task, model, mean AS clean FROM m WHERE severity = 0 AND mean > 0)
  SELECT task, model, severity, round(mean, 9) AS mean, round(clean, 9) AS clean, round(mean / clean, 9) AS relative FROM m JOIN c USING (task, model)""")
def relative_degradation(spark, d):
    return rounded(analysis.relative_degradation(_runs(spark, d)), "mean", "clean", "relative")


@query(f"""WITH {_R}, c AS (SELECT task, model, avg(accuracy) AS c FROM runs WHERE severity = 0 GROUP BY 1, 2), v AS (SELECT task, model, noise_type, avg(accuracy) AS v FROM runs WHERE severity = 3 GROUP BY 1, 2, 3)
  SELECT noise_type, model, round(avg(c - v), 9) AS loss FROM v JOIN c USING (task, model) GROUP BY 1, 2""")
def heatmap_s3(spark, d):
    return rounded(analysis.heatmap(_runs(spark, d)), "loss")


@query(f"""WITH {_R}, m AS (SELECT task, model, avg(macro_f1) FILTER (WHERE severity = 0) AS clean, avg(macro_f1) FILTER (WHERE severity > 0) AS noisy FROM runs GROUP BY 1, 2)
  SELECT task, model, round(clean, 9) AS clean, round(noisy, 9) AS noisy, CAST(rank() OVER (PARTITION BY task ORDER BY clean DESC) AS INT) AS rank_clean, CAST(rank() OVER (PARTITION BY task ORDER BY noisy DESC) AS INT) AS rank_noisy
  FROM m WHERE clean IS NOT NULL AND noisy IS NOT NULL""")
def rank_inversion(spark, d):
    return rounded(analysis.rank_inversion(_runs(spark, d)), "clean", "noisy")


# The tables have clean runs only: further conditions are derived from them by a rule both engines have, a share of the
# predictions being set right
def _derived(preds, tag: str, below: str):
    return preds.withColumn("y_pred", F.when(F.substring(F.md5(F.concat("run_id", "id", F.lit(tag))), 1, 1) < below, F.col("y_true")).otherwise(F.col("y_pred")))


def _derived_sql(tag: str, below: str) -> str:
    return f"CASE WHEN substr(md5(run_id || id || '{tag}'), 1, 1) < '{below}' THEN y_true ELSE y_pred END"


def _on(source: str, variant: str = "train_variant", y: str = "y_pred") -> str:
    """The runs of derived predictions: the same SQL over another source."""
    src = f"(SELECT replace(run_id, '__clean', '__' || '{variant}') AS run_id, severity, noise_type, id, y_true, {y} AS y_pred FROM preds)"
    return _R.replace("FROM preds WHERE", f"FROM {src} WHERE")


_VARIANTS = (("augmented_n1n4", "4"), ("augmented_n5n8", "8"))
_AUG = " UNION ALL ".join([f"(WITH {_R} SELECT * FROM runs)", *(f"(WITH {_on('preds', v, _derived_sql(v, b))} SELECT * FROM runs)" for v, b in _VARIANTS)])


@query(f"""WITH r AS ({_AUG}), g AS (SELECT model, train_variant, {_AB} AS noise_group, severity, avg(macro_f1) AS m FROM r WHERE severity > 0 GROUP BY 1, 2, 3, 4),
  c(condition, variant, noise_group) AS (VALUES ('matched', 'augmented_n1n4', 'A'), ('matched', 'augmented_n5n8', 'B'), ('mismatched', 'augmented_n1n4', 'B'), ('mismatched', 'augmented_n5n8', 'A'))
  SELECT a.model, c.condition, a.severity, round(avg(a.m), 9) AS augmented_macro_f1, round(avg(b.m), 9) AS baseline_macro_f1 FROM c JOIN g a ON a.train_variant = c.variant AND a.noise_group = c.noise_group
  JOIN g b ON b.train_variant = 'clean' AND b.noise_group = c.noise_group AND b.model = a.model AND b.severity = a.severity GROUP BY 1, 2, 3""")
def matched_mismatched(spark, d):
    preds = _preds(spark, d)
    every = preds
    for variant, below in _VARIANTS:
        every = every.unionByName(_derived(preds, variant, below).withColumn("run_id", F.regexp_replace("run_id", "__clean", f"__{variant}")))
    return rounded(analysis.augmentation_match(evaluate.runs(every)), "augmented_macro_f1", "baseline_macro_f1")


@query(f"""WITH a AS (WITH {_R} SELECT * FROM runs), b AS (WITH {_on('preds', 'clean', _derived_sql('off', '2'))} SELECT * FROM runs),
  p AS (SELECT model, noise_type, severity, seed, avg(a.macro_f1) - avg(b.macro_f1) AS d FROM a JOIN b USING (run_id, model, task, noise_type, severity, seed) GROUP BY 1, 2, 3, 4)
  SELECT model, round(avg(d), 9) AS mean_delta, round(coalesce(stddev_samp(d), 0), 9) AS sd_delta, round(max(abs(d)), 9) AS max_abs, count(*) AS n FROM p GROUP BY 1""")
def normalizer_delta(spark, d):
    """R5 with derived predictions standing for the normaliser switched off."""
    runs = _runs(spark, d).withColumn("normalizer", F.lit("on"))
    off = evaluate.runs(_derived(_preds(spark, d), "off", "2")).withColumn("normalizer", F.lit("off"))
    return rounded(analysis.normalizer_delta(runs.unionByName(off)), "mean_delta", "sd_delta", "max_abs")


@query(f"""WITH {_R} SELECT task, model, round(min(macro_f1), 9) AS lo, round(quantile_cont(macro_f1, 0.25), 9) AS q25, round(quantile_cont(macro_f1, 0.5), 9) AS q50, round(quantile_cont(macro_f1, 0.75), 9) AS q75,
  round(max(macro_f1), 9) AS hi, count(*) AS n FROM runs GROUP BY 1, 2""")
def boxplot(spark, d):
    """R14 over the runs of each task and model."""
    from ..sources.sinks import boxplot as box

    out = box(_runs(spark, d), "macro_f1", "task", "model")
    return rounded(out.select("task", "model", "lo", *(F.col("q")[k].alias(c) for k, c in enumerate(("q25", "q50", "q75"))), "hi", "n"), "lo", "q25", "q50", "q75", "hi")


@query(f"""WITH {_R}, e AS (SELECT run_id, task, model, severity AS epoch, arg_max(macro_f1, noise_type) AS v FROM runs GROUP BY 1, 2, 3, 4) SELECT task, model, epoch, round(avg(v), 9) AS mean, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def training_curves(spark, d):
    """Severities standing for epochs, the last row of each run and epoch by noise type."""
    from ..sources.sinks import training_curves as curves

    c = _runs(spark, d).select("run_id", "task", "model", F.col("severity").alias("epoch"), F.col("macro_f1").alias("val_macro_f1"), F.col("noise_type").alias("seq"))
    return rounded(curves(c), "mean")


@query(f"WITH {_R}, b AS (SELECT task, model, avg(macro_f1) AS m FROM runs WHERE severity = 0 GROUP BY 1, 2) SELECT task, first(model ORDER BY m DESC, model DESC) AS best_model, round(max(m), 9) AS best FROM b GROUP BY 1")
def best_models(spark, d):
    return rounded(analysis.best_models(_runs(spark, d)), "best")


@query(f"""WITH {_K}, t AS (SELECT *, coalesce(recall * support / nullif("precision", 0), 0) / sum(support) OVER (PARTITION BY run_id, severity, noise_type) AS rate FROM k2)
  SELECT task, model, noise_type, severity, label, round(avg(rate), 9) AS mean_rate FROM t GROUP BY 1, 2, 3, 4, 5""")
def prediction_collapse(spark, d):
    cell = [*evaluate.CELL, "model", "task"]
    per = evaluate.per_class(evaluate.clean_predictions(_preds(spark, d)), *cell)
    return rounded(analysis.prediction_collapse(per), "mean_rate")


@query(f"""WITH {_R}, x AS (SELECT run_id, severity, noise_type, nullif(macro_f1, 0) AS macro_f1 FROM runs UNION ALL SELECT run_id, severity, noise_type, macro_f1 FROM runs WHERE seed = 1337 AND severity = 3),
    g AS (SELECT run_id, severity, noise_type, count(*) AS n, sum((macro_f1 IS NULL)::INT) AS nulls FROM x GROUP BY 1, 2, 3), c AS (SELECT severity, count(*) AS c FROM g WHERE severity > 0 GROUP BY 1)
  SELECT (SELECT count(DISTINCT run_id) FROM x) AS n_runs, (SELECT count(*) FROM x) AS n_rows, (SELECT count(*) FROM g WHERE n > 1) AS n_repeated, (SELECT CAST(sum(nulls) AS BIGINT) FROM g) AS n_null_metric, (SELECT min(c) = max(c) FROM c) AS even_severities""")
def run_integrity(spark, d):
    """R1 on a table with repeated rows (one seed's at severity 3) and, where a run is wholly wrong, null metrics."""
    runs = _runs(spark, d)
    again = runs.where("seed = 1337 and severity = 3")
    return analysis.integrity(runs.withColumn("macro_f1", F.when(F.col("macro_f1") != 0, F.col("macro_f1"))).unionByName(again))


_MODELS, _TASKS = ["bert_a", "bert_b", "bert_c", "xling", "char_ngram"], ["sentnob", "bd_shs", "banfakenews"]


@query(f"""WITH {_R}, g AS (SELECT m || '__' || t || '__' || s || '__clean' AS run_id, n.noise_type, v.severity FROM (SELECT unnest({_MODELS!r}) AS m), (SELECT unnest({_TASKS!r}) AS t), (SELECT unnest({maps.SEEDS!r}) AS s), {_TYPES} n, (SELECT unnest([1, 2, 3, 4, 5]) AS severity) v
  UNION ALL SELECT m || '__' || t || '__' || s || '__clean', '', 0 FROM (SELECT unnest({_MODELS!r}) AS m), (SELECT unnest({_TASKS!r}) AS t), (SELECT unnest({maps.SEEDS!r}) AS s))
  SELECT run_id, noise_type, severity FROM g ANTI JOIN runs USING (run_id, noise_type, severity)""")
def grid_completeness(spark, d):
    expected = analysis.grid(spark, _MODELS, _TASKS, maps.SEEDS, ["clean"], [1, 2, 3, 4, 5])
    return analysis.missing_cells(expected, _runs(spark, d)).select("run_id", "noise_type", "severity")


_PAIR = f"""{_P}, j AS (SELECT a.task, a.seed, a.severity, a.noise_type, a.y_pred = a.y_true AS ra, b.y_pred = b.y_true AS rb FROM p a JOIN p b USING (task, seed, train_variant, severity, noise_type, id) WHERE a.model = 'bert_a' AND b.model = 'char_ngram')"""
_CELLS = "sum((ra AND rb)::INT) AS both_right, sum((ra AND NOT rb)::INT) AS only_a, sum((NOT ra AND rb)::INT) AS only_b, sum((NOT ra AND NOT rb)::INT) AS neither"


def _pairs(spark, d):
    return evaluate.paired(_preds(spark, d), "bert_a", "char_ngram")


@query(f"WITH {_PAIR} SELECT task, seed, severity, noise_type, {_CELLS} FROM j GROUP BY 1, 2, 3, 4")
def mcnemar_cells(spark, d):
    return evaluate.mcnemar_cells(_pairs(spark, d), "task", "seed", "severity", "noise_type")


@query(f"""WITH {_PAIR}, c AS (SELECT task, severity, {_CELLS} FROM j WHERE severity > 0 GROUP BY 1, 2)
  SELECT task, severity, both_right, only_a, only_b, neither, CASE WHEN only_a + only_b >= 25 THEN 'chi2' ELSE 'exact' END AS method,
    round(CASE WHEN only_a + only_b >= 25 THEN (abs(only_a - only_b) - 1)::DOUBLE ^ 2 / (only_a + only_b) END, 9) AS statistic, round((only_a + 0.5) / (only_b + 0.5), 9) AS odds_ratio,
    CASE WHEN only_a > only_b THEN 'a' WHEN only_a < only_b THEN 'b' ELSE 'tie' END AS winner FROM c""")
def mcnemar_stat(spark, d):
    cells = evaluate.mcnemar_cells(_pairs(spark, d).where("severity > 0"), "task", "severity")
    return rounded(evaluate.mcnemar(cells).drop("p_value"), "statistic", "odds_ratio")


def _holm_sql(source: str, keys: str, family: str = "") -> str:
    part = f"PARTITION BY {family} " if family else ""
    return f"""SELECT *, least(1.0, max((m - k + 1) * p_value) OVER ({part}ORDER BY p_value, {keys} ROWS UNBOUNDED PRECEDING)) AS p_holm
      FROM (SELECT *, row_number() OVER ({part}ORDER BY p_value, {keys}) AS k, count(*) OVER ({part}) AS m FROM ({source}))"""


_POOLED = f"SELECT *, {independent.mcnemar_p('only_a', 'only_b')} AS p_value FROM (SELECT task, severity, {_CELLS} FROM j WHERE severity > 0 GROUP BY 1, 2)"


@query(f"WITH {_PAIR} SELECT task, severity, round(p_value, 9) AS p_value, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant FROM ({_holm_sql(_POOLED, 'task, severity')})")
def mcnemar_p_value(spark, d):
    """Seeds and cells pooled before the test."""
    return rounded(evaluate.pooled_test(_pairs(spark, d)).select("task", "severity", "p_value", "p_holm", "significant"), "p_value", "p_holm")


def _seeded_sql(extra: str = "") -> str:
    return f"""SELECT *, only_a + only_b + both_right + neither AS n_items, {independent.mcnemar_p('only_a', 'only_b')} AS p_value FROM (SELECT task, severity, seed{extra}, {_CELLS} FROM j WHERE severity > 0 GROUP BY ALL)"""


def _summed_sql(extra: str = "") -> str:
    return f"""SELECT *, {independent.mcnemar_p('only_a', 'only_b')} AS p_value FROM (SELECT task, severity{extra}, count(*) AS seeds, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(only_a) AS BIGINT) AS only_a, CAST(sum(only_b) AS BIGINT) AS only_b,
      avg((both_right + only_a) / n_items) AS acc_a, avg((both_right + only_b) / n_items) AS acc_b FROM ({_seeded_sql(extra)}) GROUP BY ALL)"""


@query(f"WITH {_PAIR} SELECT task, severity, seed, n_items, only_a, only_b, round((both_right + only_a) / n_items, 9) AS acc_a, round((only_a + 0.5) / (only_b + 0.5), 9) AS odds_ratio, round(p_value, 9) AS p_value FROM ({_seeded_sql()})")
def mcnemar_by_seed(spark, d):
    """M9: one test a task, severity and seed."""
    out = evaluate.significance(_pairs(spark, d))[0]
    return rounded(out.select("task", "severity", "seed", "n_items", "only_a", "only_b", "acc_a", "odds_ratio", "p_value"), "acc_a", "odds_ratio", "p_value")


_TESTS = ["acc_a", "acc_b", "odds_ratio", "p_value", "p_holm"]
_TESTS_SQL = "seeds, n_items, only_a, only_b, round(acc_a, 9) AS acc_a, round(acc_b, 9) AS acc_b, round((only_a + 0.5) / (only_b + 0.5), 9) AS odds_ratio, round(p_value, 9) AS p_value, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant"


@query(f"WITH {_PAIR} SELECT task, severity, {_TESTS_SQL} FROM ({_holm_sql(_summed_sql(), 'task, severity')})")
def mcnemar_tests(spark, d):
    """M9: the tests by task and severity, discordant counts summed over the seeds."""
    out = evaluate.significance(_pairs(spark, d))[1]
    return rounded(out.select("task", "severity", "seeds", "n_items", "only_a", "only_b", *_TESTS, "significant"), *_TESTS)


@query(f"WITH {_PAIR} SELECT task, severity, noise_type, {_TESTS_SQL} FROM ({_holm_sql(_summed_sql(', noise_type'), 'task, severity', 'noise_type')})")
def mcnemar_by_noise(spark, d):
    """The same within each noise type."""
    out = evaluate.significance(_pairs(spark, d), "noise_type")[1]
    return rounded(out.select("task", "severity", "noise_type", "seeds", "n_items", "only_a", "only_b", *_TESTS, "significant"), *_TESTS)


@query(f"""WITH {_PAIR} SELECT task, severity, round(p_value, 9) AS p, round(p_holm, 9) AS p_holm FROM ({_holm_sql(_POOLED.replace(' WHERE severity > 0', ''), 'task, severity')})""")
def holm(spark, d):
    """W3 over the tests of all severities, the clean one included."""
    tests = evaluate.mcnemar(evaluate.mcnemar_cells(_pairs(spark, d), "task", "severity")).select("task", "severity", F.col("p_value").alias("p"))
    return rounded(evaluate.holm(tests, "p").drop("significant"), "p", "p_holm")


@query(f"""WITH {_P}, a AS (SELECT count(*) AS n_a FROM p WHERE model = 'bert_a'), b AS (SELECT count(*) AS n_b FROM p WHERE model = 'char_ngram'),
  j AS (SELECT count(*) AS n_joined, coalesce(sum((x.y_true <> y.y_true)::INT), 0) AS n_gold_differs FROM p x JOIN p y USING (task, seed, train_variant, severity, noise_type, id) WHERE x.model = 'bert_a' AND y.model = 'char_ngram') SELECT * FROM a, b, j""")
def pair_join_check(spark, d):
    return evaluate.join_check(_preds(spark, d), "bert_a", "char_ngram")


_SCORE = "substr(md5(run_id || id), 1, 2)"


@query(f"""WITH {_P}, t AS (SELECT run_id, severity, noise_type, {_SCORE} AS score, count(*) AS n, sum((y_true = 0)::INT) AS pos FROM p WHERE task <> 'sentnob' GROUP BY 1, 2, 3, 4),
  u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (PARTITION BY run_id, severity, noise_type ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT run_id, severity, noise_type, round(coalesce(sum(pos * cp / cn::DOUBLE) / nullif(sum(pos), 0), 0), 9) AS pr_auc FROM u GROUP BY 1, 2, 3""")
def pr_auc(spark, d):
    """Average precision of hash scores (the tables ship no scores), with many ties."""
    p = evaluate.clean_predictions(_preds(spark, d)).where("task <> 'sentnob'")
    p = p.withColumn("score", F.substring(F.md5(F.concat("run_id", "id")), 1, 2)).withColumn("positive", F.col("y_true") == 0)
    return rounded(evaluate.pr_auc(p, *evaluate.CELL), "pr_auc")


def _jobs(spark, d):
    p = evaluate.clean_predictions(_preds(spark, d)).groupBy("run_id", "model", "task").agg(F.countDistinct("id").alias("n_test"))
    train = records(spark, d).where("split = 'train'").groupBy(F.col("dataset").alias("task")).agg(F.count("*").alias("n_train"))
    return p.join(F.broadcast(train), "task")  # a row a dataset


@query(f"""WITH {_P}, t AS (SELECT dataset AS task, count(*) AS n_train FROM corpus_records WHERE split = 'train' GROUP BY 1), x AS (SELECT run_id, model, task, count(DISTINCT id) AS n_test FROM p GROUP BY 1, 2, 3),
  y AS (SELECT x.*, n_train, n_test * (CASE WHEN task = 'banfakenews' THEN 90 ELSE 45 END + 1) AS c FROM x JOIN t USING (task)),
  z AS (SELECT *, CASE WHEN model = 'char_ngram' THEN n_train / 4000.0 ELSE n_train / 65.0 * 1.2 * 4 END AS a, CASE WHEN model = 'char_ngram' THEN c / 20000.0 ELSE c / 200.0 END AS b FROM y)
  SELECT run_id, n_train, n_test, round(a, 6) AS train_seconds, round(b, 6) AS grid_seconds, round(CASE WHEN model = 'char_ngram' THEN 0 ELSE (a + b) / 3600 END, 6) AS gpu_h FROM z""")
def job_costs(spark, d):
    out = analysis.job_costs(_jobs(spark, d))
    return out.select("run_id", "n_train", "n_test", *(F.round(c, 6).alias(c) for c in ("train_seconds", "grid_seconds", "gpu_h")))


@query()
def bin_packing(spark, d):
    """The jobs that need a GPU."""
    return analysis.pack_sessions(analysis.job_costs(_jobs(spark, d)).where("gpu_h > 0"))


# ------------------------------------------------------------------ measures of noise


@query(f"""SELECT dataset, homophone_set, CAST(sum(n) AS BIGINT) AS n_eligible, sum((n > 0)::INT) AS texts_with_ge1, count(*) AS n_texts, round(1000.0 * sum(n) / count(*), 9) AS eligible_per_1k_texts FROM (
  """ + " UNION ALL ".join(f"SELECT dataset, '{'/'.join(s)}' AS homophone_set, len(list_filter(u, lambda x: list_contains({DUCK.array(s)}, x))) AS n FROM s" for s in maps.HOMOPHONES).replace("FROM s", "FROM (SELECT dataset, regexp_extract_all(nfc_normalize(text), '(?s).\\x{09BC}|.') AS u FROM corpus_records WHERE text IS NOT NULL)") + ") GROUP BY 1, 2")  # fmt: skip
def n5_firing(spark, d):
    return rounded(metrics.n5_firing(records(spark, d)), "eligible_per_1k_texts")


@query("""SELECT s AS homophone_set, CAST(sum(n) AS BIGINT) AS total_eligible, round(1000.0 * sum(n) / count(*), 9) AS eligible_per_1k_texts, 1000.0 * sum(n) / count(*) < 1 AS recommend_drop FROM (
  """ + " UNION ALL ".join(f"SELECT '{a}/{b}' AS s, len(regexp_extract_all(nfc_normalize(text), '[{a}{b}]')) AS n FROM corpus_records WHERE text IS NOT NULL" for a, b in ("ইঈ", "উঊ")) + ") GROUP BY 1")
def n5_review(spark, d):
    """The sets under review."""
    return rounded(metrics.n5_review(metrics.n5_firing(records(spark, d))), "eligible_per_1k_texts")


_N5 = nested(f"SELECT * FROM ({nested('SELECT dataset, nfc_normalize(text) AS t FROM corpus_records WHERE text IS NOT NULL', noise.unit_steps(DUCK, 'homophone_confuse'), '*')}) CROSS JOIN ({noise.grid_sql([3], maps.SEEDS)}) g", noise.rewrite_steps(DUCK, "homophone_confuse"), "dataset, submodes")


@query(f"SELECT dataset, split_part(m, '=', 1) AS homophone_set, CAST(sum(CAST(split_part(m, '=', 2) AS BIGINT)) AS BIGINT) AS n_applied FROM (SELECT dataset, unnest(string_split(submodes, ';')) AS m FROM ({_N5})) GROUP BY 1, 2")
def n5_applied(spark, d):
    return metrics.n5_applied(records(spark, d))


def _noised_sql(noise_type: str) -> str:
    units = nested("SELECT nfc_normalize(text) AS t FROM corpus_records WHERE text IS NOT NULL", noise.unit_steps(DUCK, noise_type), "*")
    return nested(f"SELECT * FROM ({units}) CROSS JOIN ({noise.grid_sql([1, 2, 3, 4, 5], [42])}) g", noise.rewrite_steps(DUCK, noise_type), f"'{noise_type}' AS noise_type, severity, frac, n_eligible, n_requested, n_applied, unchanged")


@query("SELECT noise_type, severity, count(*) AS n_texts, round(avg(n_eligible), 9) AS mean_eligible, round(avg(n_requested), 9) AS mean_requested, round(avg(n_applied), 9) AS mean_applied, "
       "round(coalesce(avg(n_applied / n_requested::DOUBLE) FILTER (WHERE n_requested > 0), 1), 9) AS applied_of_requested, round(sum(n_requested) / sum(n_eligible * frac), 9) AS requested_of_nominal, "
       "round(sum(n_applied) / sum(n_eligible)::DOUBLE, 9) AS achieved, round(avg((NOT unchanged)::INT), 9) AS changed FROM (" + " UNION ALL ".join(map(_noised_sql, maps.NOISE_TYPES)) + ") WHERE n_eligible > 0 GROUP BY 1, 2")  # fmt: skip
def achieved_rate(spark, d):
    texts = records(spark, d).select("text").where("text is not null")
    out = metrics.rates_of(rates.rate_sums(texts, [1, 2, 3, 4, 5], [42]))
    return rounded(out, "mean_eligible", "mean_requested", "mean_applied", "applied_of_requested", "requested_of_nominal", "achieved", "changed")


@query()
def cer_table(spark, d):
    """Samples of 300 texts a dataset, and 300 of these: the measure is defined on samples, its cost being quadratic."""
    return metrics.cer_table(metrics.grouped_samples(records(spark, d), 300, 20260902))


@query()
def cer_vs_drop(spark, d):
    return analysis.cer_vs_drop(cer_table(spark, d), _runs(spark, d))


@query()
def deletion_curve(spark, d):
    """Mean cluster error rate of deletion noise over all whole texts at severities 1 to 5."""
    texts = records(spark, d).select("dataset", "text").where("text is not null")
    rows = metrics.deletion_cer(texts, [1, 2, 3, 4, 5], [42])
    return rows.groupBy("dataset", "severity").agg(F.round(F.avg("cer"), 6).alias("cer"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT record_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256('20260902' || chr(31) || record_id)) AS r FROM corpus_records WHERE text IS NOT NULL AND dataset IS NOT NULL),
  o AS (SELECT record_id, dataset AS "group" FROM r WHERE r <= 300) SELECT * FROM o UNION ALL SELECT record_id, 'ALL' FROM (SELECT record_id, row_number() OVER (ORDER BY sha256('20260902' || chr(31) || record_id)) AS r FROM o) WHERE r <= 300""")
def sample_groups(spark, d):
    """D2."""
    return metrics.grouped_samples(records(spark, d), 300, 20260902).select("record_id", "group")


def _plain(t):
    """A stand-in normaliser: blanks collapsed, dandas unified."""
    return F.regexp_replace(F.regexp_replace(t, "॥", "।"), "(?U)\\s+", " ")


@query()
def normalizer_survival(spark, d):
    """A8 on the pooled sample of 300 texts, with the stand-in normaliser through the pluggable hook."""
    texts = metrics.grouped_samples(records(spark, d), 300, 20260902).where("`group` = 'ALL'").select("record_id", "group", "text")
    return metrics.survival(metrics.capped(texts), _plain, 3, [42])


@query()
def noise_checks(spark, d):
    """A28 on the pooled sample of 300 texts."""
    texts = metrics.grouped_samples(records(spark, d), 300, 20260902).where("`group` = 'ALL'").select("record_id", "group", "text")
    return metrics.report_checks(metrics.capped(texts))


@query()
def normalizer_examples(spark, d):
    """Twelve changed texts a dataset (the limit is the feature), described without their words."""
    return metrics.touch_examples(records(spark, d), _plain, "dataset", "record_id")


@query()
def normalizer_touch(spark, d):
    """A stand-in normaliser (blanks collapsed, dandas unified) through the pluggable hook."""
    return metrics.touched(records(spark, d), _plain, "dataset")


@query("""SELECT dataset, CAST(sum(a) AS BIGINT) AS n_before, CAST(sum(b) AS BIGINT) AS n_after, sum((a <> b)::INT) AS n_failing FROM (SELECT dataset, len(regexp_extract_all(text, '[\u09cb\u09cc]|\u09c7[\u09be\u09d7]')) AS a,
  len(regexp_extract_all(nfc_normalize(text), '[\u09cb\u09cc]')) AS b FROM corpus_records WHERE text IS NOT NULL) GROUP BY 1""")
def matra_round_trip(spark, d):
    return metrics.matra_round_trip(records(spark, d), "dataset")


@query(f"""WITH {_R}, r AS (SELECT task, model, severity, macro_f1 AS m, rank() OVER (PARTITION BY task, model ORDER BY severity) + (count(*) OVER (PARTITION BY task, model, severity) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY task, model ORDER BY round(macro_f1, 12)) + (count(*) OVER (PARTITION BY task, model, round(macro_f1, 12)) - 1) / 2.0 AS rm FROM runs)
  SELECT task, model, round(avg(m) FILTER (WHERE severity > 0), 9) AS mean_noise, round(regr_slope(m, severity), 9) AS slope, round(corr(rs, rm), 9) AS spearman FROM r GROUP BY 1, 2""")
def noise_slopes(spark, d):
    runs = _runs(spark, d).withColumn("macro_f1", F.round("macro_f1", 12))
    return rounded(analysis.noise_slopes(runs), "mean_noise", "slope", "spearman")


def _labelled(spark, d, split: str):
    """Distinct labelled texts of every dataset: in the splits it ships, or else in the seeded ones (rows without a dataset belong to none)."""
    rows = records(spark, d).where("dataset is not null and label is not null and trim(text) <> ''")
    own = F.when(F.col("dataset").isin(*prepare.SHIPPED), F.col("split")).otherwise("")
    texts = rows.groupBy("dataset", own.alias("src_split"), "text").agg(F.min("label").alias("label"), F.min("id").alias("id"))
    return prepare.with_splits(texts).where(F.col("final_split") == split).select("dataset", "text", "label", "id")


def _by_dataset(spark, d, result):
    """result(test rows, model) of every dataset, each with a classifier of its own."""
    from ..operators import models

    # every classifier reads its rows some times
    train, test = _labelled(spark, d, "train").persist(), _labelled(spark, d, "test").persist()
    out = None
    for (name,) in sorted(train.select("dataset").distinct().collect()):  # a few corpora
        own = F.col("dataset") == name
        model = models.fit(train.where(own).drop("dataset"))
        part = result(test.where(own).drop("dataset"), model).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    train.unpersist()
    return out


@query()
def char_ngram_svm(spark, d):
    """Predictions of the n-gram classifier on the test split of every dataset."""
    from ..operators import models

    return _by_dataset(spark, d, lambda test, model: models.predictor(model)(test).select("id", F.col("label").alias("y_true"), "y_pred"))


@query()
def noise_grid_eval(spark, d):
    """Its metrics by dataset on clean text and on every noise type at severities 1 to 5, one pass over the test texts."""
    from ..operators import grid

    return _by_dataset(spark, d, lambda test, model: evaluate.summary_of(grid.grid_confusion(test, model, [1, 2, 3, 4, 5], 42), "noise_type", "severity"))


@query()
def augmented_train(spark, d):
    """The training split of every dataset with half of its rows noised by types of the first group, and again of the second."""
    from ..operators import models

    train = _labelled(spark, d, "train")
    first, second = (models.train_variant(train, v, 42).withColumn("train_variant", F.lit(v)) for v in ("augmented_n1n4", "augmented_n5n8"))
    return first.unionByName(second)


_LAYER = ["qwertyuiop", "asdfghjkl-", "zxcvbnm"]
_SHIFTED = ["QWERTYUIOP", "ASDFGHJKL:", "ZXCVBNM"]
_KEYS = ", ".join(f"({n}, '{k}', {r}, {x + (0.0, 0.5, 1.5)[r]})" for n, layer in enumerate((_LAYER, _SHIFTED)) for r, keys in enumerate(layer) for x, k in enumerate(keys) if k != "-")


@query(f"""WITH k(l, k, r, x) AS (VALUES {_KEYS}) SELECT a.k AS key, list_sort(list(DISTINCT b.k)) AS neighbours FROM k a JOIN k b ON a.l = b.l AND a.k <> b.k AND abs(a.r - b.r) <= 1 AND abs(a.x - b.x) <= 1.01 GROUP BY 1""")
def keyboard_adjacency(spark, d):
    from ..operators.keyboard import adjacency

    return adjacency(spark, _LAYER, _SHIFTED)


@query()
def model_table(spark, d):
    """R12 of the models that the predictions name."""
    names = ["bert_a", "bert_b", "bert_c", "xling", "char_ngram"]
    return analysis.model_table(spark, [(n, "classical" if n == "char_ngram" else "transformer", None, None, "bn", n in ("bert_a", "bert_b")) for n in names])
