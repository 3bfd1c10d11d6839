import math

from pyspark.sql import functions as F
from shobdo.operators import analysis, corpus, evaluate, prepare
from shobdo.operators.keyboard import adjacency


def _records(spark, rows):
    full = [(i, r[0], r[1], "s", r[2], r[3] if len(r) > 3 else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "record_id long, dataset string, split string, source string, text string, label int")


def test_duplicates_and_leakage(spark):
    df = _records(spark, [("d", "train", x) for x in "abca"] + [("d", "val", x) for x in "bd"] + [("d", "test", x) for x in "cde"] + [("d", None, "a")])
    pairs = {r.split_pair: r.n_identical_texts for r in prepare.cross_split_duplicates(df).collect()}
    assert pairs == {"test|train": 1, "test|val": 1, "train|val": 1}
    leak = prepare.leakage(df).first()
    assert (leak.test_in_train, leak.val_in_train, leak.val_in_test, leak.pct_test_in_train) == (1, 1, 1, 33.333)
    q = corpus.quality_inventory(_records(spark, [("d", "train", x) for x in ("a", "b", "a", "c", "a")]), "dataset").first()
    assert (q.n_rows, q.n_unique, q.n_duplicate_rows) == (5, 3, 2)


def test_quality_and_classes(spark):
    df = _records(spark, [("d", "train", x) for x in ("আমি", "", "  ", "bad�text", "🔥 hello", None)])
    q = corpus.quality_inventory(df, "dataset").first()
    assert (q.n_empty_or_whitespace, q.n_zero_bangla, q.n_replacement_char, q.n_emoji_bearing) == (3, 5, 1, 1)
    c = {r.char_class: r.n for r in corpus.char_class_composition(df).collect()}
    assert len(c) == 8 and c["replacement"] == 1 and c["emoji"] == 1 and c["bengali"] == 3 and c["latin"] == 12
    share = {r.record_id: r.latin_share for r in corpus.latin_share(df).collect()}
    assert share[0] == 0 and share[1] == 0 and 0 < share[4] < 1
    assert corpus.quality_inventory(df.limit(0), "dataset").count() == 0


def test_upper_median_and_flags(spark):
    df = _records(spark, [("d", "train", "ক" * n, n % 2) for n in (1, 2, 3, 4)])
    s = corpus.length_stats(df, "dataset").first()
    assert (s.n_texts, s.mean_clusters, s.median_clusters) == (4, 2.5, 3)
    flags = {(r.flagged, r.label): (r.n, r.pct) for r in corpus.flag_vs_label(df, "ককক", "dataset").collect()}
    assert flags[True, "1"] == (1, 50.0)


def test_clean_and_split(spark):
    rows = [("bd_shs", "train", f"বাংলা লেখা {i}", i % 2) for i in range(100)] + [("bd_shs", "test", "বাংলা লেখা 1", 1), ("bd_shs", "test", "ab", 0), ("bd_shs", "test", "english only", 0)]
    rows += [("sentnob", "train", "একই লেখা", 0), ("sentnob", "test", "একই  লেখা", 1), ("sentnob", "test", "একই লেখা", 2), ("sentnob", None, "অন্য লেখা", 2)]
    df = _records(spark, rows)
    stats = {r.dataset: r for r in prepare.prep_stats(df).collect()}
    b = stats["bd_shs"]
    assert (b.n_raw, b.dupes_removed, b.short_removed, b.non_bengali_removed, b.n_final) == (103, 1, 1, 1, 100)
    assert (stats["sentnob"].dupes_removed, stats["sentnob"].n_final) == (1, 3)
    out = prepare.with_splits(prepare.cleaned_all(df).where("verdict = ''"))
    sizes = {(r.dataset, r.final_split): r["count"] for r in out.groupBy("dataset", "final_split").count().collect()}
    assert sizes["bd_shs", "train"] == 70 and sizes["bd_shs", "val"] == 10 and sizes["bd_shs", "test"] == 20
    assert sizes["sentnob", "train"] == 1 and sizes["sentnob", "test"] == 1
    again = prepare.with_splits(prepare.cleaned_all(df.repartition(7)).where("verdict = ''"))
    assert {(r.id, r.final_split) for r in out.collect()} == {(r.id, r.final_split) for r in again.collect()}
    assert prepare.sample(df, "record_id", 5, 1).count() == 5 and prepare.sample(df, "record_id", 3, 1, "dataset").count() == 6


def test_metrics_by_hand(spark):
    true, pred = [0, 0, 0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1, 1, 0]
    df = spark.createDataFrame([("m__t__1__clean", 0, None, str(i), a, b) for i, (a, b) in enumerate(zip(true, pred))] + [("m__t__1__clean", 0, None, "0", 0, 0), ("m__t__1__clean", 0, None, "9", 1, None)],
                               "run_id string, severity int, noise_type string, id string, y_true int, y_pred int")
    r = evaluate.runs(df).first()
    assert r.n_test_items == 8 and r.accuracy == 0.75
    f0, f1 = 2 * 2 / 6, 2 * 4 / 10
    assert math.isclose(r.macro_f1, (f0 + f1) / 2) and math.isclose(r.weighted_f1, (3 * f0 + 5 * f1) / 8)
    assert math.isclose(r.balanced_accuracy, (2 / 3 + 4 / 5) / 2) and math.isclose(r.mcc, (2 * 4 - 1 * 1) / math.sqrt(3 * 5 * 3 * 5))
    scored = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, positive boolean")
    assert math.isclose(evaluate.pr_auc(scored).first().pr_auc, 0.5 * 1 + 0.5 * 2 / 3)


def test_mcnemar_and_holm(spark):
    cells = spark.createDataFrame([("a", 5, 1), ("b", 40, 10), ("c", 3, 3), ("d", 0, 0)], "k string, only_a long, only_b long")
    out = {r.k: r for r in evaluate.mcnemar(cells).collect()}
    assert math.isclose(out["a"].p_value, 2 * (1 + 6) / 64) and out["a"].method == "exact"
    assert math.isclose(out["b"].statistic, 29**2 / 50) and math.isclose(out["b"].p_value, math.erfc(math.sqrt(29**2 / 100)))
    assert out["c"].p_value == 1 and out["d"].p_value == 1 and out["b"].winner == "a"
    h = {r.k: r.p_holm for r in evaluate.holm(spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "k string, p_value double")).collect()}
    assert h == {"x": 0.03, "z": 0.06, "y": 0.06}


def test_analysis(spark):
    rows = [("t", m, "clean", s, n, v, f) for m, c in (("p", 0.9), ("q", 0.8)) for s in (1, 2) for n, v, f in (("", 0, c), ("char_insert", 5, c - (0.3 if m == "p" else 0.05)))]
    runs = spark.createDataFrame(rows, "task string, model string, train_variant string, seed int, noise_type string, severity int, macro_f1 double").withColumn("accuracy", F.col("macro_f1")).withColumn("run_id", F.concat_ws("__", "model", "task", "seed", "train_variant"))
    rank = {r.model: (r.rank_clean, r.rank_noisy) for r in analysis.rank_inversion(runs).collect()}
    assert rank == {"p": (1, 2), "q": (2, 1)}
    assert analysis.curve_table(runs).where("severity = 0").count() == 18
    assert math.isclose(analysis.robustness(runs).where("model = 'p'").first().abs_drop, 0.3)
    wide = runs.withColumn("normalizer", F.lit("off")).unionByName(runs.withColumn("normalizer", F.lit("on")).withColumn("macro_f1", F.col("macro_f1") + 0.1))
    d = analysis.normalizer_delta(wide).first()
    assert math.isclose(d.mean_delta, 0.1) and d.n == 4
    expected = analysis.grid(spark, ["p", "q"], ["t"], [1, 2], ["clean"], [5])
    assert expected.count() == 40 and analysis.missing_cells(expected, runs).count() == 32
    jobs = spark.createDataFrame([("a", 10.0), ("b", 6.0), ("c", 5.0), ("d", 1.0), ("e", 11.0)], "run_id string, gpu_h double")
    packed = {r.run_id: (r.session, r.week) for r in analysis.pack_sessions(jobs).collect()}
    assert packed["e"][0] == 0 and packed["a"][0] == packed["d"][0] == 1 and packed["b"][0] == packed["c"][0] == 2 and packed["b"][1] == 1


def test_keyboard(spark):
    out = {r.key: r.neighbours for r in adjacency(spark, ["qwe", "asd", "zxc"]).collect()}
    assert out["q"] == ["a", "w"] and out["s"] == ["a", "d", "e", "w", "x", "z"]
    assert all(k in out[n] for k in out for n in out[k])
    both = {r.key: r.neighbours for r in adjacency(spark, ["ab-", "cd"], ["AB", "cD"]).collect()}
    assert both["a"] == ["b", "c"] and both["A"] == ["B", "c"] and both["c"] == ["A", "B", "D", "a", "b", "d"] and "-" not in both
    flat = {r.key: r.neighbours for r in adjacency(spark, ["qwe", "asd"], diagonals=False).collect()}
    assert flat["w"] == ["e", "q"]


def test_classes_of_characters_by_the_unicode_database(spark):
    """Characters of the basic plane and the emoji blocks (of an old Unicode, which all engines know) against a plain definition."""
    import unicodedata

    from shobdo.functions import maps
    from shobdo.functions.text import char_class_patterns

    def plain(c):
        if c == "\ufffd":
            return "replacement"
        if any(a <= ord(c) <= b for a, b in maps.EMOJI_RANGES):
            return "emoji"
        name = unicodedata.name(c, "")
        if name.startswith("BENGALI "):
            return "bengali"
        if name.startswith("LATIN "):
            return "latin"
        return "digit" if c.isdigit() else "punctuation" if unicodedata.category(c)[0] == "P" else "whitespace" if c.isspace() else "other"

    chars = [chr(i) for i in [*range(1, 0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1FB00)] if unicodedata.ucd_3_2_0.category(chr(i)) not in ("Cn", "Cs", "Lm", "Nl") and "LATIN" not in unicodedata.name(chr(i), "")[1:]]
    case = F.lit("other")
    for k, p in reversed(char_class_patterns().items()):
        case = F.when(F.col("c").rlike(p), k).otherwise(case)
    skip = {"\u212a", "\u212b", "\u00aa", "\u00ba"}  # Latin by script, not by name
    got = {r.c: r.k for r in spark.createDataFrame([(c,) for c in chars if c not in skip], "c string").select("c", case.alias("k")).collect()}
    assert {c: (k, plain(c)) for c, k in got.items() if k != plain(c) and not (ord(c) >= 0x1D00 and plain(c) == "other" and k == "latin")} == {}


def test_mentions_of_every_script(spark):
    from shobdo.functions.dialect import SPARK
    from shobdo.functions.text import preprocess

    df = spark.createDataFrame([("ي@ripon @हि x@y _@z (@ক্ষ) কhttps://a.b https://a.b",)], "t string")
    assert df.select(F.expr(preprocess(SPARK, "t")).alias("c")).first().c == "ي@ripon <USER>ि x@y _@z (<USER>) কhttps://a.b <URL>"


def test_ecdf_has_a_step_a_row(spark):
    df = _records(spark, [("d", "train", "ক" * n) for n in (3, 1, 3, 2)])
    assert [(r.step, r.n, r.share) for r in corpus.length_ecdf(df).orderBy("step").collect()] == [(1, 1, 0.25), (2, 2, 0.5), (3, 3, 0.75), (4, 3, 1.0)]


def test_augmentation_is_compared_with_clean_runs(spark):
    rows = [("m", v, n, 3, x) for v, n, x in (("clean", "char_insert", 0.5), ("clean", "elongate", 0.7), ("augmented_n1n4", "char_insert", 0.8), ("augmented_n1n4", "elongate", 0.6), ("augmented_n5n8", "elongate", 0.9), ("clean", "whitespace_error", 0.1))]
    out = {r.condition: r for r in analysis.augmentation_match(spark.createDataFrame(rows, "model string, train_variant string, noise_type string, severity int, macro_f1 double")).collect()}
    assert math.isclose(out["matched"].augmented_macro_f1, 0.85) and math.isclose(out["matched"].baseline_macro_f1, 0.6)
    assert math.isclose(out["mismatched"].augmented_macro_f1, 0.6) and math.isclose(out["mismatched"].baseline_macro_f1, 0.6)


def test_job_costs(spark):
    jobs = spark.createDataFrame([("bert", "sentnob", 650, 200), ("char_ngram", "sentnob", 4000, 20000), ("bert", "banfakenews", 650, 200)], "model string, task string, n_train long, n_test long")
    a, b, c = analysis.job_costs(jobs).collect()
    assert math.isclose(a.train_seconds, 48) and math.isclose(a.grid_seconds, 46) and math.isclose(a.gpu_h, 94 / 3600)
    assert math.isclose(b.train_seconds, 1) and math.isclose(b.grid_seconds, 46) and b.gpu_h == 0 and math.isclose(c.grid_seconds, 91)


def test_cross_split_warning(spark):
    df = _records(spark, [("d", "train", "ক খ"), ("d", "test", "ক  খ"), ("d", "test", "ক খ"), ("d", "val", "গ"), ("d", None, "গ")])
    assert prepare.cross_split_warning(df).first().n_rows_recurring == 3
