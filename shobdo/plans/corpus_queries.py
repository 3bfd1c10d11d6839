"""Queries of cleaning, splits and corpus metrics over corpus_records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import DUCK
from ..functions.text import cluster_count, nfc, orphan_nukta, valid_output
from ..operators import analysis, corpus, metrics, noise, prepare
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


_T = "SELECT *, coalesce(text, '') AS t FROM corpus_records"
_N = "SELECT *, nfc_normalize(coalesce(text, '')) AS t FROM corpus_records"


@query(f"SELECT record_id, {cluster_count(DUCK, 't')} AS n FROM ({_N})")
def clusters_len(spark, d):
    df = records(spark, d).withColumn("text", nfc(F.coalesce("text", F.lit(""))))
    return corpus.lengths(df, "record_id")


@query(f"""SELECT record_id, CAST(len(regexp_extract_all(t, '[^{maps.WS}]+')) AS INT) AS n_tokens,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(t, '[^{maps.WS}]+'), lambda w: {DUCK.occurrences('w', maps.CLUSTER)})), 0) AS INT) AS longest FROM ({_N})""")
def token_spans(spark, d):
    df = records(spark, d).select("record_id", nfc(F.coalesce("text", F.lit(""))).alias("t"))
    tokens = F.regexp_extract_all("t", F.lit(f"[^{maps.WS}]+"), F.lit(0))
    sizes = F.transform(tokens, lambda w: F.regexp_count(w, F.lit(maps.CLUSTER)))
    return df.select("record_id", F.size(tokens).alias("n_tokens"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"))


@query(f"SELECT record_id, md5({independent.cleaned('t')}) AS clean_md5 FROM ({_N})")
def preprocess_text(spark, d):
    return prepare.preprocessed(records(spark, d).select("record_id", "text")).select("record_id", F.md5("clean_text").alias("clean_md5"))


_CLASSES = {c: independent.count("t", p) for c, p in independent.CLASSES.items()}


@query(
    "WITH s AS (SELECT dataset, " + ", ".join(f"sum({e}) AS {c}" for c, e in _CLASSES.items()) + f", sum(length(t)) AS total FROM ({_T}) GROUP BY dataset), "
    "o AS (SELECT *, total - " + " - ".join(_CLASSES) + ' AS "other" FROM s) '
    + " UNION ALL ".join(f"SELECT dataset, '{c}' AS char_class, CAST(\"{c}\" AS BIGINT) AS n FROM o" for c in maps.CHAR_CLASSES)
)
def char_class_composition(spark, d):
    return corpus.char_class_composition(records(spark, d))


@query(f"SELECT record_id, round(CASE WHEN length(t) = 0 THEN 0 ELSE {_CLASSES['latin']} / length(t)::DOUBLE END, 9) AS latin_share FROM ({_T})")
def latin_share(spark, d):
    return corpus.latin_share(records(spark, d)).withColumn("latin_share", F.round("latin_share", 9))


_QUALITY = f"""count(*) AS n_rows, count(DISTINCT t) AS n_unique, count(*) - count(DISTINCT t) AS n_duplicate_rows,
  sum((NOT regexp_matches(t, '[^{independent.SPACE}]'))::INT) AS n_empty_or_whitespace, sum((NOT regexp_matches(t, '\\p{{Bengali}}'))::INT) AS n_zero_bangla,
  sum(contains(t, chr(65533))::INT) AS n_replacement_char, sum(regexp_matches(t, '[{maps.EMOJI}]')::INT) AS n_emoji_bearing"""


@query(f"SELECT delivery_id, dataset, {_QUALITY} FROM ({_T}) GROUP BY 1, 2")
def quality_inventory(spark, d):
    return corpus.quality_inventory(records(spark, d), "delivery_id", "dataset")


_NAMES = "n_rows, n_unique, n_duplicate_rows, n_empty_or_whitespace, n_zero_bangla, n_replacement_char, n_emoji_bearing"


@query(f"""WITH o AS (SELECT delivery_id, dataset, {_QUALITY} FROM ({_T}) GROUP BY 1, 2)
  SELECT q.delivery_id, q.dataset, {', '.join('q.' + x for x in _NAMES.split(', '))}, coalesce(({', '.join('q.' + x for x in _NAMES.split(', '))}) = ({', '.join('o.' + x for x in _NAMES.split(', '))}), false) AS agrees FROM quality_inventory q LEFT JOIN o USING (delivery_id, dataset)""")
def quality_inventory_agrees(spark, d):
    """The shipped figures next to whether a recount gives the same."""
    ours = quality_inventory(spark, d)
    shipped = spark.read.parquet(f"{d}/quality_inventory.parquet")
    names = [c for c in ours.columns if c.startswith("n_")]
    both = shipped.join(ours.select("delivery_id", "dataset", F.struct(*names).alias("o")), ["delivery_id", "dataset"], "left")
    return both.select("delivery_id", "dataset", *names, F.coalesce(F.struct(*names) == F.col("o"), F.lit(False)).alias("agrees"))


_KEY = "CASE WHEN dataset = 'sentnob' THEN coalesce(split, '') ELSE '' END"
_CLEAN = f"""SELECT dataset, {_KEY} AS key_split, {independent.cleaned('t')} AS clean_text, min(record_id) AS record_id, count(*) AS n_copies,
  arg_min(coalesce(split, ''), record_id) AS src_split, arg_min(coalesce(label, -1), record_id) AS label FROM ({_N}) GROUP BY 1, 2, 3"""
_VERDICT = f"""SELECT *, CASE WHEN {cluster_count(DUCK, 'clean_text')} < 3 THEN 'short' WHEN NOT regexp_matches(clean_text, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'non_bengali' ELSE '' END AS verdict,
  dataset || '-' || substr(sha1(dataset || chr(0) || key_split || chr(0) || clean_text), 1, 16) AS id FROM ({_CLEAN})"""


@query(f"SELECT dataset, key_split, md5(clean_text) AS text_md5, record_id, n_copies FROM ({_CLEAN})")
def dup_keep_first(spark, d):
    return prepare.cleaned_all(records(spark, d), "clean_text").select("dataset", "key_split", F.md5("clean_text").alias("text_md5"), "record_id", "n_copies")


@query(f"SELECT id, dataset, verdict FROM ({_VERDICT})")
def clean_rows(spark, d):
    return prepare.cleaned_all(records(spark, d)).select("id", "dataset", "verdict")


@query(f"""SELECT dataset, CAST(sum(n_copies) AS BIGINT) AS n_raw, CAST(sum(n_copies - 1) AS BIGINT) AS dupes_removed, sum((verdict = 'short')::INT) AS short_removed,
  sum((verdict = 'non_bengali')::INT) AS non_bengali_removed, sum((verdict = '')::INT) AS n_final FROM ({_VERDICT}) GROUP BY 1""")
def prep_stats(spark, d):
    return prepare.prep_stats(records(spark, d))


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY sha256('42' || chr(31) || id)) - 1 AS r, count(*) OVER (PARTITION BY dataset, label) AS n
  FROM ({_VERDICT}) WHERE verdict = '' AND dataset <> 'sentnob' AND label >= 0"""
_SPLIT = f"""SELECT id, dataset, label, src_split AS final_split FROM ({_VERDICT}) WHERE verdict = '' AND dataset = 'sentnob' AND src_split IN ('train', 'val', 'test')
  UNION ALL SELECT id, dataset, label, CASE WHEN r < round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN r < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END FROM ({_RANKED})"""


def _split(spark, d):
    # the split reads the cleaned rows twice: for the counts of hash buckets, and for the ranks in them
    return prepare.with_splits(prepare.cleaned_all(records(spark, d)).where("verdict = ''").persist())


@query(f"SELECT id, dataset, final_split FROM ({_SPLIT})")
def stratified_split(spark, d):
    return _split(spark, d).select("id", "dataset", "final_split")


@query(f"SELECT dataset, final_split, CAST(NULLIF(label, -1) AS VARCHAR) AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dataset, final_split), 9) AS pct FROM ({_SPLIT}) GROUP BY dataset, final_split, label")
def class_balance(spark, d):
    return corpus.class_balance(_split(spark, d), "dataset", "final_split").withColumn("pct", F.round("pct", 9))


def _cross_sql(a: str, b: str) -> str:
    return f"SELECT dataset, '{a}|{b}' AS split_pair, sum((list_contains(s, '{a}') AND list_contains(s, '{b}'))::INT) AS n_identical_texts FROM x GROUP BY 1"


@query(f"WITH x AS (SELECT dataset, t, list(DISTINCT split) AS s FROM ({_T}) WHERE split IS NOT NULL GROUP BY 1, 2) " + " UNION ALL ".join(_cross_sql(*p) for p in (("test", "train"), ("test", "val"), ("train", "val"))))
def cross_split_duplicates(spark, d):
    return prepare.cross_split_duplicates(records(spark, d))


def _leak_sql(t: str) -> str:
    inside = lambda s, o: f"sum((split = '{s}' AND EXISTS (SELECT 1 FROM x y WHERE y.dataset = x.dataset AND y.t = x.t AND y.split = '{o}'))::INT)"
    pct = lambda c, s: f"round(coalesce(100.0 * {c} / nullif({s}, 0), 0), 3)"
    return f"""WITH x AS (SELECT dataset, split, {t} AS t FROM ({_N.replace('nfc_normalize', '') if t == 't' else _N}) WHERE split IS NOT NULL),
      s AS (SELECT dataset, {inside('test', 'train')} AS test_in_train, {inside('val', 'train')} AS val_in_train, {inside('val', 'test')} AS val_in_test,
        sum((split = 'test')::INT) AS a, sum((split = 'val')::INT) AS b FROM x GROUP BY 1)
      SELECT dataset, test_in_train, val_in_train, val_in_test, {pct('test_in_train', 'a')} AS pct_test_in_train, {pct('val_in_train', 'b')} AS pct_val_in_train, {pct('val_in_test', 'b')} AS pct_val_in_test FROM s"""


@query(_leak_sql("t"))
def leakage_raw(spark, d):
    return prepare.leakage(records(spark, d))


@query(_leak_sql(independent.cleaned("t")))
def leakage_clean(spark, d):
    df = prepare.preprocessed(records(spark, d).select("dataset", "split", "text"))
    return prepare.leakage(df, "clean_text")


@query(f"""WITH l AS (SELECT dataset, {cluster_count(DUCK, 't')} AS n FROM ({_T}))
  SELECT dataset, count(*) AS n_texts, round(avg(n), 9) AS mean_clusters, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_clusters,
    round(100.0 * sum((n > 300)::INT) / count(*), 9) AS pct_over_cap FROM l GROUP BY 1""")
def length_stats_upper_median(spark, d):
    return corpus.length_stats(records(spark, d), "dataset").withColumns({"mean_clusters": F.round("mean_clusters", 9), "pct_over_cap": F.round("pct_over_cap", 9)})


@query(f"""SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY n) AS step, n, round(row_number() OVER (PARTITION BY dataset ORDER BY n) / count(*) OVER (PARTITION BY dataset), 9) AS share
  FROM (SELECT dataset, {cluster_count(DUCK, 't')} AS n FROM ({_T}))""")
def length_ecdf(spark, d):
    return corpus.length_ecdf(records(spark, d)).withColumn("share", F.round("share", 9))


@query(f"""WITH c AS (SELECT dataset, regexp_matches(t, '[{maps.EMOJI}]') AS flagged, CAST(label AS VARCHAR) AS label, count(*) AS n FROM ({_T}) GROUP BY 1, 2, 3)
  SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY dataset, flagged), 9) AS pct FROM c""")
def flag_vs_label(spark, d):
    return corpus.flag_vs_label(records(spark, d), f"[{maps.EMOJI}]", "dataset").withColumn("pct", F.round("pct", 9))


@query(f"SELECT dataset, split, count(*) AS n_rows, sum(regexp_matches(t, '[{maps.EMOJI}]')::INT) AS n_bearing, round(avg(regexp_matches(t, '[{maps.EMOJI}]')::INT), 9) AS rate FROM ({_T}) GROUP BY 1, 2")
def emoji_rate(spark, d):
    return corpus.bearing_rate(records(spark, d), f"[{maps.EMOJI}]", "dataset", "split").withColumn("rate", F.round("rate", 9))


_PCT = ", ".join(f"round(100.0 * sum({e}) / sum(length(t)), 6) AS pct_{c}" for c, e in _CLASSES.items()) + ", round(100.0 * (sum(length(t)) - " + " - ".join(f"sum({e})" for e in _CLASSES.values()) + ") / sum(length(t)), 6) AS pct_other"
_RAW_Q = f"SELECT dataset, {_QUALITY}, {_PCT} FROM ({_T}) GROUP BY 1"
_FIN_Q = f"SELECT dataset, {_QUALITY}, {_PCT} FROM (SELECT dataset, clean_text AS t FROM ({_VERDICT}) WHERE verdict = '') GROUP BY 1"
_METRICS = [*_NAMES.split(", "), *(f"pct_{c}" for c in maps.CHAR_CLASSES)]


@query(f"WITH a AS ({_RAW_Q}), b AS ({_FIN_Q}) " + " UNION ALL ".join(
    f"SELECT dataset, '{m}' AS metric, a.{m}::DOUBLE AS raw_value, b.{m}::DOUBLE AS final_value, round((b.{m} - a.{m})::DOUBLE, 6) AS delta, round(CASE WHEN a.{m} = 0 THEN 0 ELSE 100.0 * b.{m} / a.{m} END, 3) AS pct_of_raw FROM a JOIN b USING (dataset)" for m in _METRICS))
def raw_final_delta(spark, d):
    rows = records(spark, d)
    final = prepare.cleaned_all(rows, "clean_text").where("verdict = ''").select("dataset", F.col("clean_text").alias("text"))

    def full(df):
        return corpus.with_class_percent(corpus.quality_inventory(df, "dataset"), corpus.char_class_composition(df)).select("dataset", *(F.round(m, 6).alias(m) if m.startswith("pct") else m for m in _METRICS))

    out = corpus.raw_final_delta(full(rows), full(final), "dataset")
    return out.withColumns({"pct_of_raw": F.round("pct_of_raw", 3), "delta": F.round("delta", 6)})


@query("WITH s AS (SELECT dataset, " + ", ".join(f"sum({e}) AS {c}" for c, e in _CLASSES.items()) + f", sum(length(t)) AS total FROM ({_T}) GROUP BY dataset) SELECT dataset, "
       + ", ".join(f"round(100.0 * {c} / total, 6) AS {c}" for c in _CLASSES) + ", round(100.0 * (total - " + " - ".join(_CLASSES) + ') / total, 6) AS "other" FROM s')
def class_percent(spark, d):
    out = analysis.class_percent(corpus.char_class_composition(records(spark, d)))
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in maps.CHAR_CLASSES))


@query(f"SELECT dataset, round(100.0 * sum(contains(t, chr(65533))::INT) / count(*), 6) AS pct_replacement, round(100.0 * sum(regexp_matches(t, '[{maps.EMOJI}]')::INT) / count(*), 6) AS pct_emoji FROM ({_T}) WHERE dataset IS NOT NULL GROUP BY 1")
def bars(spark, d):
    rows = records(spark, d)
    out = analysis.bars(corpus.quality_inventory(rows, "dataset"), corpus.bearing_rate(rows, f"[{maps.EMOJI}]", "dataset"))
    return out.select("dataset", F.round("pct_replacement", 6).alias("pct_replacement"), F.round("pct_emoji", 6).alias("pct_emoji"))


@query(f"""WITH x AS (SELECT dataset, split, {independent.cleaned('t')} AS c FROM ({_N}) WHERE split IS NOT NULL)
  SELECT dataset, CAST(coalesce(sum(n) FILTER (WHERE s > 1), 0) AS BIGINT) AS n_rows_recurring FROM (SELECT dataset, c, count(*) AS n, count(DISTINCT split) AS s FROM x GROUP BY 1, 2) GROUP BY 1""")
def cross_split_warning(spark, d):
    return prepare.cross_split_warning(records(spark, d))


@query(f"""SELECT dataset, count(*) AS n_test_texts, sum(regexp_matches(t, '[{maps.EMOJI}]')::INT) AS n_emoji_bearing, round(100.0 * avg(regexp_matches(t, '[{maps.EMOJI}]')::INT), 6) AS pct_emoji_bearing FROM ({_T}) WHERE split = 'test' GROUP BY 1""")
def n10_test_split(spark, d):
    """Emoji-bearing rows of the whole test splits as shipped."""
    out = corpus.bearing_rate(records(spark, d).where("split = 'test'"), f"[{maps.EMOJI}]", "dataset")
    return out.select("dataset", F.col("n_rows").alias("n_test_texts"), F.col("n_bearing").alias("n_emoji_bearing"), F.round(100.0 * F.col("rate"), 6).alias("pct_emoji_bearing"))


@query()
def emoji_coverage(spark, d):
    """A10 against the pictographs of the Unicode database (categories So and Sk of the symbol blocks)."""
    import unicodedata

    known = [(chr(i),) for i in [*range(0x2190, 0x2BFF), *range(0x1F000, 0x1FB00)] if unicodedata.category(chr(i)) in ("So", "Sk")]
    return metrics.emoji_coverage(records(spark, d), spark.createDataFrame(known, "emoji string"))


@query(f"SELECT record_id, text IS NOT NULL AND {independent.valid('t')} AS valid, {independent.orphan('t')} AS orphan FROM ({_T})")
def is_valid_output(spark, d):
    from ..functions.dialect import SPARK

    df = records(spark, d).select("record_id", F.col("text").isNotNull().alias("has"), F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumn("normal", nfc("t"))
    return df.select("record_id", (F.col("has") & F.expr(valid_output(SPARK, "t", "normal"))).alias("valid"), F.expr(orphan_nukta(SPARK, "t")).alias("orphan"))


def _eligible_sql() -> str:
    from ..functions.dialect import nested

    src = "SELECT dataset, nfc_normalize(text) AS t FROM corpus_records WHERE text IS NOT NULL"
    one = [nested(src, noise.unit_steps(DUCK, x), f"dataset, '{x}' AS noise_type, {noise.eligible_count(DUCK)} AS n_eligible") for x in maps.NOISE_TYPES]
    return "SELECT dataset, noise_type, CAST(sum(n_eligible) AS BIGINT) AS n_eligible, sum((n_eligible > 0)::INT) AS n_texts FROM (" + " UNION ALL ".join(one) + ") GROUP BY 1, 2"


@query(_eligible_sql())
def eligible_units(spark, d):
    from ..functions.dialect import SPARK, bound

    df = noise.spread(records(spark, d).select("dataset", "text").where("text is not null")).select("dataset", nfc("text").alias("t"))
    counts = [F.struct(F.lit(x).alias("noise_type"), F.expr(bound([*noise.unit_steps(SPARK, x), ("n_eligible", noise.eligible_count(SPARK))], ["n_eligible"]) + ".n_eligible").alias("n_eligible")) for x in maps.NOISE_TYPES]
    return df.select("dataset", F.inline(F.array(*counts))).groupBy("dataset", "noise_type").agg(F.sum("n_eligible").alias("n_eligible"), F.count_if(F.col("n_eligible") > 0).alias("n_texts"))


@query("SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY dataset ORDER BY sha256('20260902' || chr(31) || record_id)) AS r FROM corpus_records) WHERE r <= 300")
def reservoir_sample(spark, d):
    return prepare.sample(records(spark, d).select("record_id", "dataset"), "record_id", 300, 20260902, "dataset").select("record_id")
