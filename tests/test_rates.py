import random
import unicodedata

from pyspark.sql import functions as F
from shobdo.functions import maps
from shobdo.operators import noise, rates

ODD = [
    "", " ", "\n", "া", "ক", "কক", "মম মম মম", "হাহা হাহাহা", "\r\nক\r\n\r\nখ গ", "\nেকাখ", " ঁক খ", "াক িে াখ", "ক্ক্ক ক্‍ষ ক়্খ", "ড়ঢ়য় ড়় র়", "ক্্খ ক্‌খ গ্ঘ",
    "a b  c  d", "ab", "abab abab", "éé 😀😀 👍🏽", "কে াক", "  আমি  ভাত খাই  ", "শষস নণ ইঈ উঊ িী ুূ রড়ঢ় জয", "১২৩ ৪৫৬", "ো", "ক" * 300, "কখ " * 150, "\x00\x1c\x85", "ৎৎ ংং ঃঃ", "क़ড়ঢ়য়",
]


def _texts() -> list[str]:
    r = random.Random(7)
    letters = [*"কখগমনতরসহাািীুূেোৈ়্্্ঁংঃৎঅআইঈউ১২।abz \n\t\r  ", " ", "‌", "‍", "́", "😀", "ড়", "য়"]
    return ODD + ["".join(r.choices(letters, k=r.randint(1, 70))) for _ in range(300)]


def test_counts_are_those_of_the_noised_texts(spark):
    texts, marks = _texts(), rates.marks(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    units = rates.Units([unicodedata.normalize("NFC", x) for x in texts], marks)
    for kind in maps.NOISE_TYPES:
        rows = noise.perturb(df, kind, [1, 2, 3, 4, 5], [42, 7]).select("id", "severity", "seed", "n_eligible", "n_requested", "n_applied", ~F.col("unchanged")).collect()
        for severity in range(1, 6):
            for seed in (42, 7):
                want = sorted(tuple(r)[:1] + tuple(r)[3:] for r in rows if (r.severity, r.seed) == (severity, seed))
                assert list(zip(range(len(texts)), *(x.tolist() for x in units.cell(kind, severity, seed)), strict=True)) == want, (kind, severity)


def test_order_of_units_beyond_48_bits(spark, monkeypatch):
    """Hashes that agree in their first 48 bits are told apart by the rest."""
    texts = ["কখ " * 20, "আমি ভাত"]
    units = rates.Units(texts, rates.marks(spark))
    asked = units.requested("char_delete", 5, 42)
    want = units.deleted(*asked).tolist()
    own = rates._hashes
    monkeypatch.setattr(rates, "_hashes", lambda *a: own(*a) >> rates.np.uint64(48))
    assert units.deleted(*asked).tolist() == want


def test_achieved_rate_reads_its_table_once_and_no_interpreted_arrays(spark, tmp_path):
    """Over nine unions of interpreted array functions it did not end on 0.1 GB."""
    from shobdo.plans import core

    spark.createDataFrame([(i, x) for i, x in enumerate(_texts())], "record_id int, text string").write.parquet(f"{tmp_path}/corpus_records.parquet")
    plan = core.QUERIES["achieved_rate"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "transform(" not in plan
