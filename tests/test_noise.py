import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F
from shobdo.functions import maps
from shobdo.functions.dialect import SPARK
from shobdo.functions.text import clusters, nfc, preprocess
from shobdo.operators import metrics, noise

SENTENCES = [
    "আমি ভাত খাই এবং বই পড়ি।", "বাংলাদেশের ক্রিকেট দল আজ ভালো খেলেছে!", "শিক্ষক ছাত্রদের সঙ্গে বিদ্যালয়ে গেলেন",
    "ঢাকা শহরে যানজট খুব বেশি ১২৩", "এই ওষুধ ঊর্ধ্বে ঈদ উৎসব", "নির্বাচন কমিশন জানিয়েছে ফল প্রকাশ হবে", "good movie ছিল ২০২০ সালে 🔥",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(SENTENCES) for _ in range(3))) for i in range(120)]
    return spark.createDataFrame(rows, "id long, text string").cache()


def test_maps():
    maps.check()


def test_severity_is_checked():
    for bad in (0, 6, -1, 3.0, True, "3"):
        with pytest.raises(ValueError):
            noise.fraction(bad)
    with pytest.raises(ValueError):
        noise.unit_steps(SPARK, "emoji_transform")
    with pytest.raises(ValueError):
        noise.emoji_steps(SPARK, "drop")


def test_clusters_equal_grapheme_rule(spark):
    rows = [(s,) for s in SENTENCES + ["ক্ষ জ্ঞ স্ত্র ড়", "a\r\nb", ""]]
    got = spark.createDataFrame(rows, "t string").select(nfc("t").alias("t")).select("t", clusters(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == regex.findall(r"\X", r.t)


@pytest.mark.parametrize("noise_type", maps.NOISE_TYPES)
def test_contract(texts, noise_type):
    out = noise.perturb(texts, noise_type, [1, 2, 3, 4, 5], [42, 7])
    rows = metrics.with_distance(out, "t", "noised").collect()
    again = {(r.id, r.severity, r.seed): r.noised for r in noise.perturb(texts.repartition(5), noise_type, [1, 2, 3, 4, 5], [42, 7]).collect()}
    mean = {s: 0.0 for s in range(1, 6)}
    asked = {s: 0 for s in range(1, 6)}
    units = {s: 0 for s in range(1, 6)}
    changed = total = 0
    for r in rows:
        assert again[r.id, r.severity, r.seed] == r.noised
        assert 0 <= r.n_applied <= r.n_requested <= r.n_eligible
        assert r.n_applied == r.n_requested or noise_type in ("char_delete", "char_transpose")
        assert unicodedata.is_normalized("NFC", r.noised) and "�" not in r.noised
        assert r.unchanged == (r.noised == r.t)
        assert sum(int(x.split("=")[1]) for x in r.submodes.split(";")) == r.n_applied
        mean[r.severity] += r.cer
        asked[r.severity] += r.n_requested
        units[r.severity] += r.n_eligible
        if r.severity == 5 and r.n_requested:
            total += 1
            changed += not r.unchanged
    assert all(mean[s + 1] > mean[s] for s in range(1, 5))
    assert changed >= 0.95 * total
    for s in range(1, 6):
        nominal = units[s] * maps.FRACTIONS[s]
        assert abs(asked[s] - nominal) <= 0.06 * nominal + 3 * nominal**0.5 * 0.5
    assert len({r.noised for r in rows if r.id == 0 and r.severity == 5}) == 2 or noise_type == "conjunct_split"


def test_words_never_vanish(texts):
    for r in noise.perturb(texts, "char_delete", [5], [1, 2]).collect():
        assert len(r.noised.split()) == len(r.t.split())


def test_nukta_letters_stay_whole(spark):
    df = spark.createDataFrame([(i, "ড়ড়ড় য়য়য় ঢ়ঢ়ঢ় রড়য") for i in range(50)], "id long, text string").withColumn("text", F.concat("text", F.lit(" "), F.col("id").cast("string")))
    for kind in ("char_substitute", "homophone_confuse", "char_delete"):
        for r in noise.perturb(df, kind, [5], [3]).collect():
            assert not regex.search("(^|[^\\p{Lo}])়", r.noised)


def test_nothing_eligible_and_edges(spark):
    df = spark.createDataFrame([(1, "কলম বই"), (2, ""), (3, None), (4, "   "), (5, "ক")], "id long, text string")
    for kind in maps.NOISE_TYPES:
        out = {r.id: r for r in noise.perturb(df, kind, [5], [42]).collect()}
        assert out[2].noised == "" and out[2].n_eligible == 0 and out[2].unchanged and out[3].noised is None
        assert out[4].noised == "   "
    assert {r.id: r.n_eligible for r in noise.perturb(df, "conjunct_split", [5], [1]).collect()}[1] == 0
    assert noise.perturb(df.limit(0), "char_insert", [1], [1]).count() == 0


def test_emoji_modes(spark):
    df = spark.createDataFrame([(1, "ভালো 🔥🔥 খুব"), (2, "x"), (3, "👍️")], "id long, text string")
    out = lambda mode: {r.id: r.noised for r in noise.emoji_transform(df, mode).collect()}
    assert out("keep")[1] == "ভালো 🔥🔥 খুব"
    assert out("remove") == {1: "ভালো খুব", 2: "x", 3: ""}
    assert out("replace_with_text")[1] == "ভালো :fire::fire: খুব" and out("replace_with_text")[3] == ":thumbs_up_sign:"


def test_preprocess(spark):
    df = spark.createDataFrame([("  See   https://a.b/c?d=1  @Ripon   ABC  ",), ("é@Ripon x@y.z",), ("@আমি, WWW.x.y",)], "t string")
    assert [r.c for r in df.select(F.expr(preprocess(SPARK, "t")).alias("c")).collect()] == ["See <URL> <USER> ABC", "é@Ripon x@y.z", "<USER>, <URL>"]


def test_edit_distance(spark):
    rng = random.Random(2)
    pool = ["ক", "ক্ষ", "খা", "a", "é", "🔥"]
    rows = [("".join(rng.choice(pool) for _ in range(rng.randint(0, 9))), "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for _ in range(80)] + [("", ""), ("ক" * 400, "খ" * 400)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for r in metrics.with_distance(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect():
        x, y = regex.findall(r"\X", r.a), regex.findall(r"\X", r.b)
        assert r.distance == lev(x, y) and r.cer == r.distance / max(1, len(x))


def test_severity_ratios(spark):
    df = spark.createDataFrame([("g", 0.05, 0.10, 0.20, 0.35, 0.50), ("h", 0.05, 0.10, 0.11, 0.35, 0.30)], "g string, s1 double, s2 double, s3 double, s4 double, s5 double")
    out = {r.g: r for r in metrics.severity_ratios(df).collect()}
    assert out["g"].rule_holds_s3plus and out["g"].strictly_increasing and not out["h"].rule_holds_s3plus and not out["h"].strictly_increasing


def test_eligible_units_by_plain_rules(spark):
    """Eligible units of every type, counted by a plain rule over clusters and characters."""
    texts = [*SENTENCES, "ক", "ক খ", "  কলম   বই ", "ড়য়ঢ় ক্ষ্ম ক্ষ স্ত্র", "কো কৌ অ আ", "a b cc ১২", "\u09be ক \u0981x", ""]

    def plain(t):
        cl, spans, ws = regex.findall(r"\X", t), [], lambda c: bool(c) and all(x.isspace() for x in c)
        for i, c in enumerate(cl):
            if not ws(c):
                if spans and spans[-1][1] == i:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i, i + 1])
        long = [b - a for a, b in spans if b - a >= 2]
        pools = set(maps.CONSONANTS + maps.VOWELS + maps.DIGITS)
        members = {m for s in maps.HOMOPHONES for m in s}
        out = {"char_insert": sum(n - 1 for n in long), "char_delete": sum(long), "char_transpose": sum(n - 1 for n in long)}
        out["char_substitute"] = sum(c[:2] in pools or c[:1] in pools for c in cl)
        out["homophone_confuse"] = sum(u in members for u in regex.findall(r"(?s).\u09bc|.", t))
        out["matra_perturb"] = sum(c in maps.DROP_TARGETS for c in t)
        single = {c for c in maps.CONSONANTS if len(c) == 1}
        out["conjunct_split"] = sum(c.count("\u09cd") == 1 and 0 < c.index("\u09cd") < len(c) - 1 and c[c.index("\u09cd") - 1] in single and c[c.index("\u09cd") + 1] in single for c in cl)
        out["elongate"] = sum(any(x in maps.MATRAS or x in maps.VOWELS for x in c) for c in cl)
        tokens = [regex.findall(r"\X", w) for w in t.split()]
        out["whitespace_error"] = sum(c[0] not in maps.COMBINING for w in tokens for c in w[1:]) + max(0, len(tokens) - 1)
        return out

    df = spark.createDataFrame([(i, unicodedata.normalize("NFC", t)) for i, t in enumerate(texts)], "id long, text string")
    for kind in maps.NOISE_TYPES:
        got = {r.id: r.n_eligible for r in noise.perturb(df, kind, [1], [1]).collect()}
        assert got == {i: plain(unicodedata.normalize("NFC", t))[kind] for i, t in enumerate(texts)}, kind


def test_deletion_rate_is_the_edit_distance(texts):
    rows = metrics.deletion_cer(texts, [1, 3, 5], [42])
    full = {(r.id, r.severity): r.cer for r in metrics.with_distance(noise.perturb(texts, "char_delete", [1, 3, 5], [42]), "t", "noised").collect()}
    assert {(r.id, r.severity): r.cer for r in rows.collect()} == full


def test_applied_of_requested_is_a_mean_of_ratios(spark):
    df = spark.createDataFrame([("x", 1, 10, 4, 1, False), ("x", 1, 10, 1, 1, False), ("x", 1, 10, 0, 0, True)], "noise_type string, severity int, n_eligible int, n_requested int, n_applied int, unchanged boolean")
    assert metrics.achieved_rates(df).first().applied_of_requested == 0.625


def test_touched_texts_are_described(spark):
    df = spark.createDataFrame([("d", 1, "ab 12"), ("d", 2, "ক।"), ("d", 3, "same"), ("d", 4, "ﬁx"), ("ALL", 5, "ba")], "g string, id long, text string")

    def normalize(t):
        return F.when(t == "ab 12", "ba 1").when(t == "ﬁx", "fix").when(t == "ক।", "ক!").when(t == "ba", "ab").otherwise(t)

    out = {(r.g, r.kind): r for r in metrics.touched(df, normalize, "g").collect()}
    assert set(out) == {("d", "digit, len 5->4"), ("d", "punctuation"), ("d", "unchanged"), ("d", "latin, len 2->3, ==NFKC"), ("ALL", "other")}
    assert out["d", "unchanged"].touch_rate == 0.75 and out["d", "unchanged"].recommend_drop is False and out["ALL", "other"].recommend_drop is None
    first = {r.id: r for r in metrics.touch_examples(df, normalize, "g", "id").collect()}
    assert (first[1].offset_first_diff, first[1].length_before, first[1].length_delta) == (0, 5, -1) and first[2].offset_first_diff == 1


def test_emoji_coverage_and_survival(spark, texts):
    df = spark.createDataFrame([("ভালো 🔥🔥 ⌚",), ("☂",), (None,)], "text string")
    r = metrics.emoji_coverage(df, spark.createDataFrame([("🔥",), ("⌚",)], "emoji string")).first()
    assert (r.n_occurrences, r.n_caught_any, r.n_caught_full, r.n_false_positive_codepoints, r.uncaught) == (3, 2, 2, 1, ["⌚"])
    out = {r.noise_type: r for r in metrics.survival(texts.limit(10), lambda t: F.regexp_replace(t, " ", ""), 3, [42]).collect()}
    assert len(out) == 9 and out["char_delete"].touch_rate == 1.0 and out["char_delete"].post_normalizer_cer > 0
    checks = metrics.report_checks(texts.limit(30)).collect()
    assert len(checks) == 9 and {c.noise_type for c in checks if not (c.deterministic and c.n_invalid == 0 and c.changes)} <= {"conjunct_split"}  # one unit a text, taken half of the time
