import pytest
from pyspark.sql import functions as F
from shobdo.operators import models


def test_train_variants(spark):
    df = spark.createDataFrame([(f"i{i}", "বাংলা লেখা পড়ি আর ক্ষমা চাই", i % 2) for i in range(200)], "id string, text string, label int")
    out = models.train_variant(df, "augmented_n5n8", 42)
    changed = out.where("text <> 'বাংলা লেখা পড়ি আর ক্ষমা চাই'").count()
    assert out.count() == 200 and 40 <= changed <= 120
    assert {r.id: r.text for r in out.collect()} == {r.id: r.text for r in models.train_variant(df.repartition(3), "augmented_n5n8", 42).collect()}
    assert models.train_variant(df, "clean", 1) is df
    with pytest.raises(ValueError):
        models.train_variant(df, "other", 1)


def test_classifier_and_grid(spark):
    good, bad = "ভালো সুন্দর দারুণ", "খারাপ বাজে ফালতু"
    train = spark.createDataFrame([(f"i{i}", f"{good if i % 2 else bad} {i % 5}", i % 2) for i in range(40)], "id string, text string, label int")
    predict = models.predictor(models.fit(train, iterations=5))
    test = spark.createDataFrame([("a", good, 1), ("b", bad, 0)], "id string, text string, label int")
    assert {r.id: r.y_pred for r in predict(test).collect()} == {"a": 1, "b": 0}
    grid = {(r.noise_type, r.severity): r for r in models.evaluate_grid(test, predict, [1], 42, ["char_delete"]).collect()}
    assert set(grid) == {("", 0), ("char_delete", 1)} and grid["", 0].macro_f1 == 1


def test_every_ngram_of_two_texts_is_a_feature(spark):
    words = spark.range(9_000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(" "), F.md5(F.lit("x"))).alias("w"), (F.col("id") % 2).cast("int").alias("label"))
    rows = words.select(F.col("w").alias("text"), "label").unionByName(words.select(F.col("w").alias("text"), "label"))
    df = rows.select(models.char_ngrams().alias("g")).select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").count().where("count >= 2").count()
    assert df > 50_000 and len(models.fit(rows, iterations=1).stages[0].stages[0].vocabulary) == df


def test_classifier_queries_take_every_dataset(spark, tmp_path):
    from shobdo.plans import core

    rows = []
    for name in ("sentnob", "bd_shs", "banfakenews"):
        for i in range(60):
            split = ("train", "train", "test")[i % 3] if name == "sentnob" else None
            rows.append((len(rows), f"{name}{i}", name, split, f"{'ভালো সুন্দর' if i % 2 else 'খারাপ বাজে'} লেখা পড়ি {i}", i % 2))
    spark.createDataFrame(rows, "record_id long, id string, dataset string, split string, text string, label int").write.parquet(f"{tmp_path}/corpus_records.parquet")
    predicted = core.QUERIES["char_ngram_svm"](spark, str(tmp_path)).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in predicted} == {"sentnob": 20, "bd_shs": 12, "banfakenews": 12}
    noised = core.QUERIES["augmented_train"](spark, str(tmp_path)).groupBy("dataset", "train_variant").count().collect()
    assert {(r["dataset"], r["train_variant"]): r["count"] for r in noised} == {(d, v): n for d, n in (("sentnob", 40), ("bd_shs", 42), ("banfakenews", 42)) for v in ("augmented_n1n4", "augmented_n5n8")}


def test_ngrams_of_short_words_count_once(spark):
    got = sorted(spark.createDataFrame([("A bc",)], "text string").select(models.char_ngrams().alias("g")).first().g)
    assert got == sorted([" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "])


def test_job_runs_once(spark, tmp_path):
    train = spark.createDataFrame([(f"i{i}", f"{'ভালো সুন্দর' if i % 2 else 'খারাপ বাজে'} {i % 5}", i % 2) for i in range(30)], "id string, text string, label int")
    path = str(tmp_path / "r")
    assert models.run_job("char_ngram", "t", 42, "clean", train, train, path, [1], ["char_delete"])
    assert not models.run_job("char_ngram", "t", 42, "clean", train, train, path, [1], ["char_delete"])
    assert {(r.noise_type, r.severity) for r in spark.read.parquet(path).collect()} == {("none", 0), ("char_delete", 1)}
