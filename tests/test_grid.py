import unicodedata

import numpy as np
from pyspark.sql import functions as F
from shobdo.functions import maps
from shobdo.operators import evaluate, grid, models, noise, rates
from test_rates import _texts


def _split(code) -> list[str]:
    return [x[1:].astype("<u4").tobytes().decode("utf-32-le") for x in np.split(code, np.flatnonzero(code == 0x110000))[1:-1]]


def test_letters_are_those_of_the_noise_operators(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    units = grid.Noised([unicodedata.normalize("NFC", x) for x in texts], rates.marks(spark))
    for kind in maps.NOISE_TYPES:
        rows = noise.perturb(df, kind, [1, 2, 3, 4, 5], [42]).select("id", "severity", "noised").collect()
        for severity in range(1, 6):
            assert _split(units.noised(kind, severity, 42)) == [r.noised for r in sorted(rows) if r.severity == severity], (kind, severity)


def test_grid_is_that_of_the_noised_rows(spark):
    """One pass over the texts, where a union of a plan for each type did not end on 0.1 GB."""
    texts = [x for x in _texts() if x.strip()] + ["İstanbul ΑΣ ΣΑ", "A bc", "x　y\x1cz"]
    df = spark.createDataFrame([(f"i{i}", x, (len(x or "") + i) % 3) for i, x in enumerate([*texts, *texts[:40], None])], "id string, text string, label int")
    model = models.fit(df.where("text is not null"), iterations=3)
    want = models.evaluate_grid(df, models.predictor(model), [1, 5], 42, ["char_delete", "whitespace_error"])
    counts = grid.grid_confusion(df, model, [1, 5], 42, ["char_delete", "whitespace_error"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    got = evaluate.summary_of(counts, "noise_type", "severity")
    key = lambda r: (r.noise_type, r.severity)
    flat = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(df.collect(), key=key)]
    assert got.columns == want.columns and flat(got) == flat(want)
    predicted = models.predictor(model)(df).select("id", "y_pred").orderBy(F.col("id").substr(2, 9).cast("int")).collect()
    code = rates.Units([x or "" for x in [*texts, *texts[:40], None]], rates.marks(spark)).code
    assert grid.Scorer(model).predictions(code, len(predicted)).tolist() == [r.y_pred for r in predicted]


def test_ngrams_of_words_are_those_of_the_texts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*_texts(), "A bc", "x　y\x1cz", None])], "id int, text string")
    got = {r.id: sorted(r.grams) for r in models.with_ngrams(df).collect()}
    assert got == {r.id: sorted(r.g) for r in df.select("id", models.char_ngrams().alias("g")).collect()}
