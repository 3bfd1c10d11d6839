"""Measures of noise: cluster error rate, achieved rates, firing counts.

The edit distance over clusters is Spark's own on strings in which every distinct cluster of a pair is one character.
Defined results: two empty texts are 0 apart; null text gives null; a rate without eligible units is not averaged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import SPARK, staged
from ..functions.text import char_class_patterns, nfc, nfkc, valid_output
from .noise import perturb
from .prepare import sample


def _coded(units: str) -> str:
    # a character beyond U+4E00 for each entry of the pair's dictionary
    return SPARK.join(SPARK.each(units, lambda c, i: f"decode(unhex(hex(19967 + array_position(_dict, {c}))), 'UTF-16BE')"))


def with_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """A1, A2: the columns distance and cer of two NFC text columns; cer is relative to the first and may exceed 1."""
    steps = [
        ("_ua", SPARK.find_all(f"`{a}`", maps.CLUSTER)), ("_ub", SPARK.find_all(f"`{b}`", maps.CLUSTER)), ("_dict", "array_distinct(concat(_ua, _ub))"),
        ("distance", f"levenshtein({_coded('_ua')}, {_coded('_ub')})"),
        ("cer", "distance / CAST(greatest(1, size(_ua)) AS DOUBLE)"),
    ]
    return staged(df, steps).select(*df.columns, "distance", "cer")


def capped(df: DataFrame, text: str = "text", cap: int = maps.CER_CAP) -> DataFrame:
    """the first clusters of a text, for measures of quadratic cost only."""
    return df.withColumn(text, F.expr(SPARK.join(f"slice({SPARK.find_all(text, maps.CLUSTER)}, 1, {cap})")))


def grouped_samples(records: DataFrame, k: int, seed: int) -> DataFrame:
    """K rows of each dataset, and k of these together as group ALL."""
    own = sample(records.select("record_id", "dataset", "text").where("text is not null and dataset is not null"), "record_id", k, seed, "dataset")
    own = own.withColumnRenamed("dataset", "group")
    pooled = sample(own, "record_id", k, seed).withColumn("group", F.lit("ALL"))
    return own.unionByName(pooled)


def all_types(df: DataFrame, severities: list[int], seeds: list[int], types: list[str] = maps.NOISE_TYPES) -> DataFrame:
    return reduce(DataFrame.unionByName, [perturb(df, x, severities, seeds) for x in types])


def cer_table(texts: DataFrame, severities: list[int] = (1, 2, 3, 4, 5), seeds: list[int] = tuple(maps.SEEDS)) -> DataFrame:
    """A3 to A6 by group and type: mean error rate at each severity, ratios of neighbours, whether the last three
    ratios are within a tenth of their targets, and whether the curve rises strictly."""
    noised = with_distance(all_types(capped(texts), list(severities), list(seeds)), "t", "noised")
    means = noised.groupBy("group", "noise_type").pivot("severity", list(severities)).agg(F.avg("cer"))
    for s in severities:
        means = means.withColumnRenamed(str(s), f"s{s}")
    return severity_ratios(means)


def severity_ratios(means: DataFrame) -> DataFrame:
    """A5, A6 over columns s1 to s5."""
    ratio = lambda k: F.try_divide(F.col(f"s{k + 1}"), F.col(f"s{k}"))
    out = means.withColumns({f"s{k + 1}_s{k}": ratio(k) for k in range(1, 5)})
    holds = F.lit(True)
    for k, target in zip(range(2, 5), maps.TARGET_RATIOS[1:], strict=True):
        r = F.col(f"s{k + 1}_s{k}")
        holds = holds & (r.isNull() | (F.abs(r - target) <= 0.1 * target))
    rising = reduce(lambda x, y: x & y, [F.col(f"s{k + 1}") > F.col(f"s{k}") for k in range(1, 5)])
    return out.withColumn("rule_holds_s3plus", holds).withColumn("strictly_increasing", rising)


def rate_terms(noised: DataFrame) -> DataFrame:
    """The sums of the rates over rows of perturb with eligible units, as rates.rate_sums has them without noised texts."""
    frac = F.element_at(F.create_map(*[F.lit(x) for kv in maps.FRACTIONS.items() for x in kv]), F.col("severity"))
    asking, one = F.col("n_requested") > 0, F.lit(1).cast("long")
    return noised.where("n_eligible > 0").select(
        "noise_type", "severity", one.alias("n_texts"), F.col("n_eligible").alias("eligible"), F.col("n_requested").alias("requested"), F.col("n_applied").alias("applied"), asking.cast("long").alias("n_asking"),
        F.when(asking, F.col("n_applied") / F.col("n_requested")).otherwise(F.lit(0.0)).alias("ratios"), (F.col("n_eligible") * frac).alias("nominal"), (~F.col("unchanged")).cast("long").alias("changed"),
    )


def achieved_rates(noised: DataFrame) -> DataFrame:
    """A7, A27 by type and severity, over rows with eligible units; applied_of_requested is the mean of the rows' own
    ratios, rows that ask for nothing left out (1 where all do), the other rates are ratios of means."""
    return rates_of(rate_terms(noised))


def rates_of(terms: DataFrame) -> DataFrame:
    """achieved_rates from the sums of any parts of the rows."""
    s = F.sum
    return terms.groupBy("noise_type", "severity").agg(
        s("n_texts").alias("n_texts"), (s("eligible") / s("n_texts")).alias("mean_eligible"), (s("requested") / s("n_texts")).alias("mean_requested"), (s("applied") / s("n_texts")).alias("mean_applied"),
        F.coalesce(F.try_divide(s("ratios"), s("n_asking")), F.lit(1.0)).alias("applied_of_requested"),
        (s("requested") / s("nominal")).alias("requested_of_nominal"),
        (s("applied") / s("eligible")).alias("achieved"),
        (s("changed") / s("n_texts")).alias("changed"),
    )


def n5_firing(records: DataFrame, by: str = "dataset") -> DataFrame:
    """Eligible occurrences of every homophone set, per thousand texts, and texts with one; sets without any are 0."""
    names = ["/".join(s) for s in maps.HOMOPHONES]
    units = F.regexp_extract_all("t", F.lit(r"(?s).\x{09BC}|."), F.lit(0))

    def members(s: list[str]):
        return F.size(F.filter("u", lambda x: x.isin(*s)))

    n = [F.struct(F.lit(name).alias("homophone_set"), members(s).alias("n")) for name, s in zip(names, maps.HOMOPHONES, strict=True)]
    rows = records.where("text is not null").select(by, nfc("text").alias("t")).select(by, units.alias("u")).select(by, F.inline(F.array(*n)))
    return rows.groupBy(by, "homophone_set").agg(F.sum("n").alias("n_eligible"), F.count_if(F.col("n") > 0).alias("texts_with_ge1"), F.count("*").alias("n_texts"), (F.lit(1000.0) * F.sum("n") / F.count("*")).alias("eligible_per_1k_texts"))


def matra_round_trip(df: DataFrame, by: str, normalize=None) -> DataFrame:
    """Two-part vowel signs before and after NFC (or a pluggable normaliser), and texts in which their number changes."""
    n = lambda c: F.regexp_count(c, F.lit("[োৌ]|ে[াৗ]"))
    t = df.where("text is not null").select(by, F.col("text").alias("t"), (normalize or nfc)(F.col("text")).alias("z")).select(by, n("t").alias("a"), F.regexp_count("z", F.lit("[োৌ]")).alias("b"))
    return t.groupBy(by).agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), F.count_if(F.col("a") != F.col("b")).alias("n_failing"))


def n5_applied(records: DataFrame, severity: int = 3, seeds: list[int] = tuple(maps.SEEDS), by: str = "dataset") -> DataFrame:
    """Replaced units of every homophone set, summed over seeds, from the submodes."""
    rows = perturb(records.where("text is not null").select(by, "text"), "homophone_confuse", [severity], list(seeds))
    mode = rows.select(by, F.explode(F.split("submodes", ";")).alias("m")).select(by, F.split_part("m", F.lit("="), F.lit(1)).alias("homophone_set"), F.split_part("m", F.lit("="), F.lit(2)).cast("long").alias("n"))
    return mode.groupBy(by, "homophone_set").agg(F.sum("n").alias("n_applied"))


# Sets under review, and the occurrences in a thousand texts below which they are dropped
REVIEWED, LEAST_PER_1K = ("ই/ঈ", "উ/ঊ"), 1.0


def n5_review(firing: DataFrame) -> DataFrame:
    """Occurrences of the sets under review over all datasets, and whether to drop them; firing as of n5_firing."""
    f = firing.where(F.col("homophone_set").isin(*REVIEWED)).groupBy("homophone_set").agg(F.sum("n_eligible").alias("total_eligible"), F.sum("n_texts").alias("n_texts"))
    per = F.lit(1000.0) * F.col("total_eligible") / F.greatest(F.lit(1), F.col("n_texts"))
    return f.select("homophone_set", "total_eligible", per.alias("eligible_per_1k_texts"), (per < LEAST_PER_1K).alias("recommend_drop"))


def char_differences(before: str = "t", after: str = "z"):
    """(class, characters more on either side) of two texts: the multiset difference of their characters, both ways.

    Characters are counted by their distinct values, so the cost is the text's length times its alphabet."""
    chars = f"array_distinct(concat(split({before}, ''), split({after}, '')))"
    n = lambda t: f"(length({t}) - length(replace({t}, c, '')))"
    cls = "CASE " + " ".join(f"WHEN c RLIKE {SPARK.lit(p)} THEN '{k}'" for k, p in char_class_patterns().items()) + " ELSE 'other' END"
    return f"transform(filter({chars}, c -> c <> ''), c -> struct({cls} AS k, abs({n(before)} - {n(after)}) AS n))"


def described(df: DataFrame, before: str, after: str) -> DataFrame:
    """F18, F19 for two text columns: kind (classes by falling number of changed characters, the lengths if they differ, ==NFKC where
    compatibility composition gives the same), offset of the first difference, length before and its change."""
    d = df.withColumn("_d", F.expr(char_differences(f"`{before}`", f"`{after}`"))).withColumn("_k", nfkc(F.col(before)))
    totals = F.expr("filter(transform(array({}), k -> struct(-aggregate(filter(_d, x -> x.k = k), 0, (a, x) -> a + x.n) AS m, k AS k)), x -> x.m < 0)".format(", ".join(f"'{c}'" for c in maps.CHAR_CLASSES)))
    tags = F.transform(F.array_sort(totals), lambda x: x["k"])
    lens = F.when(F.length(before) != F.length(after), F.array(F.concat(F.lit("len "), F.length(before), F.lit("->"), F.length(after)))).otherwise(F.array())
    same = F.when(F.col("_k") == F.col(after), F.array(F.lit("==NFKC"))).otherwise(F.array())
    joined = F.array_join(F.concat(tags, lens, same), ", ")
    kind = F.when(F.col(before) == F.col(after), "unchanged").when(joined == "", "other").otherwise(joined)
    first = F.expr(f"array_position(zip_with(split(`{before}`, ''), split(`{after}`, ''), (x, y) -> x IS NULL OR y IS NULL OR x <> y), true)")
    offset = F.when(F.col(before) == F.col(after), F.length(before)).otherwise(first - 1).cast("int")
    return d.withColumns({"kind": kind, "offset_first_diff": offset, "length_before": F.length(before), "length_delta": F.length(after) - F.length(before)}).drop("_d", "_k")


# Fixed value: share of touched texts below which a dataset's normaliser condition is dropped
LEAST_TOUCHED = 0.05


def touched(df: DataFrame, normalize, by: str, text: str = "text") -> DataFrame:
    """F16, A26 by group: kinds of change that a pluggable normaliser (Column -> Column) makes, most frequent first, the
    share of texts it changes and whether that is too small to keep the condition (null for the pooled group ALL)."""
    t = df.where(F.col(text).isNotNull()).select(by, nfc(text).alias("t")).withColumn("z", normalize(F.col("t")))
    kinds = described(t, "t", "z").groupBy(by, "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)  # kinds of one group: few
    rate = F.sum(F.when(F.col("kind") != "unchanged", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    out = kinds.withColumn("touch_rate", rate)
    return out.withColumn("recommend_drop", F.when(F.col(by) != "ALL", F.col("touch_rate") < LEAST_TOUCHED))


def touch_examples(df: DataFrame, normalize, by: str, key: str, k: int = 12, text: str = "text") -> DataFrame:
    """The first k changed texts of each group by key, described without their words (the limit is the feature)."""
    t = df.where(F.col(text).isNotNull()).select(by, key, nfc(text).alias("t")).withColumn("z", normalize(F.col("t"))).where("t <> z")
    first = t.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_r") <= k)
    return described(first, "t", "z").select(by, key, "kind", "offset_first_diff", "length_before", "length_delta")


def survival(texts: DataFrame, normalize, severity: int = 3, seeds: list[int] = tuple(maps.SEEDS)) -> DataFrame:
    """A8 by type: mean error rate of the original against the normalised noisy text, and how often the normaliser changed anything."""
    noisy = all_types(texts, [severity], list(seeds)).withColumn("z", normalize(F.col("noised")))
    rows = with_distance(noisy.select("noise_type", "t", "noised", nfc("z").alias("z")), "t", "z")
    return rows.groupBy("noise_type").agg(F.avg("cer").alias("post_normalizer_cer"), F.avg((F.col("z") != F.col("noised")).cast("int")).alias("touch_rate"))


def emoji_coverage(df: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """A10: how far the emoji ranges agree with a list of emoji sequences (`known`, one column emoji): occurrences in
    the texts, those with any and with all characters in the ranges (what glues sequences left out), and the distinct
    characters that only the ranges call emoji.  The list is joined by broadcast (a few thousand rows at most)."""
    glue = "".join(rf"\x{{{ord(c):x}}}" for c in maps.EMOJI_GLUE)
    e = known.select("emoji").distinct().withColumn("core", F.regexp_replace("emoji", f"[{glue}]", ""))
    e = e.withColumns({"n": F.length("core"), "hits": F.regexp_count("core", F.lit(f"[{maps.EMOJI}]"))})
    t = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    # sequences as whole clusters of the text
    seen = t.select(F.explode(F.expr("regexp_extract_all(t, '\\\\X', 0)")).alias("emoji")).where(F.length("emoji") > 0).groupBy("emoji").agg(F.count("*").alias("c"))
    hit = seen.join(F.broadcast(e), "emoji")
    count = hit.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_occurrences"), F.coalesce(F.sum(F.when(F.col("hits") > 0, F.col("c"))), F.lit(0)).alias("n_caught_any"),
        F.coalesce(F.sum(F.when((F.col("n") > 0) & (F.col("hits") == F.col("n")), F.col("c"))), F.lit(0)).alias("n_caught_full"),
        F.slice(F.array_sort(F.collect_set(F.when((F.col("n") > 0) & (F.col("hits") == 0), F.col("emoji")))), 1, 25).alias("uncaught"),
    )
    chars = seen.select(F.explode(F.split("emoji", "")).alias("ch")).where(F.col("ch").rlike(f"^[{maps.EMOJI}]$")).distinct()
    over = chars.join(hit.select(F.explode(F.split("core", "")).alias("ch")).distinct(), "ch", "left_anti").agg(F.count("*").alias("n_false_positive_codepoints"))
    share = lambda c: F.coalesce(F.try_divide(c, "n_occurrences"), F.lit(0.0))
    return count.crossJoin(over).withColumns({"coverage_any": share("n_caught_any"), "coverage_full": share("n_caught_full")})  # one row each


def report_checks(texts: DataFrame, seeds: list[int] = (42,)) -> DataFrame:
    """A28, A27 by type: whether noise is the same again, rises with severity, stays valid, and changes what is eligible at 5."""
    noised = all_types(texts, [1, 2, 3, 4, 5], list(seeds))
    again = all_types(texts, [1, 2, 3, 4, 5], list(seeds)).groupBy("noise_type").agg(F.sum(F.xxhash64("t", "severity", "seed", "noised").cast("decimal(38,0)")).alias("h2"))
    # NFC runs in Python, so what is aggregated is computed before
    n = with_distance(noised, "t", "noised").withColumn("normal", nfc("noised")).withColumn("valid", F.expr(valid_output(SPARK, "noised", "normal")) | ~F.expr(valid_output(SPARK, "t", "t")))
    rate = lambda s: F.avg(F.when(F.col("severity") == s, F.col("cer")))
    out = n.groupBy("noise_type").agg(
        F.sum(F.xxhash64("t", "severity", "seed", "noised").cast("decimal(38,0)")).alias("h1"), *(rate(s).alias(f"s{s}") for s in range(1, 6)),
        F.count_if(~F.col("valid")).alias("n_invalid"), F.avg(F.when((F.col("severity") == 5) & (F.col("n_eligible") > 0), (~F.col("unchanged")).cast("int"))).alias("changed_s5"),
    )
    rising = reduce(lambda x, y: x & y, [F.col(f"s{k + 1}") > F.col(f"s{k}") for k in range(1, 5)])
    return out.join(again, "noise_type").select("noise_type", (F.col("h1") == F.col("h2")).alias("deterministic"), rising.alias("strictly_increasing"), "n_invalid", (F.col("changed_s5") >= 0.95).alias("changes"))


def deletion_cer(texts: DataFrame, severities: list[int], seeds: list[int]) -> DataFrame:
    """Noised rows of deletion noise with their error rate.  What remains is a subsequence of the text's clusters, so if it still has as
    many clusters as were left, the distance is the number deleted; only where clusters have joined is it computed."""
    own = texts.withColumn("text", nfc("text")).withColumn("_n", F.regexp_count("text", F.lit(maps.CLUSTER)))
    rows = perturb(own, "char_delete", severities, seeds)
    rows = rows.withColumn("_plain", F.regexp_count("noised", F.lit(maps.CLUSTER)) == F.col("_n") - F.col("n_applied"))
    # one pass: where the distance is known, two empty texts are compared
    rest = with_distance(rows.withColumns({"_a": F.when(~F.col("_plain"), F.col("t")).otherwise(""), "_b": F.when(~F.col("_plain"), F.col("noised")).otherwise("")}), "_a", "_b")
    known = F.col("n_applied") / F.greatest(F.lit(1), F.col("_n")).cast("double")
    return rest.withColumn("cer", F.when(F.col("_plain"), known).otherwise(F.col("cer"))).drop("_n", "_plain", "_a", "_b", "distance")
