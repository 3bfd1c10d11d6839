"""Character n-gram classifier, training-set augmentation and the evaluation of a model over a noise grid in one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import maps
from .evaluate import summary
from .metrics import all_types

TRAIN_VARIANTS = {"clean": None, "augmented_n1n4": "A", "augmented_n5n8": "B"}


def char_ngrams(text: str = "text", low: int = 2, high: int = 5):
    """L1: n-grams of each word padded by a blank, in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    def grams(w, n: int):
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        # a word shorter than n is one n-gram of its own, for the least n it is shorter than or as long as only
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, all_).otherwise(F.array().cast("array<string>")) if n > low else all_

    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*(grams(w, n) for n in range(low, high + 1))))))


#: What (?U)\s+ matches
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(1 << 17)
def _word_ngrams(word: str, low: int, high: int) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1)) or (padded,)


def with_ngrams(df: DataFrame, text: str = "text", low: int = 2, high: int = 5) -> DataFrame:
    """The rows with char_ngrams as grams in place of text, words being cut once a worker."""
    rest = [c for c in df.columns if c != text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = [[g for w in _BLANKS.split((x or "").lower()) if w for g in _word_ngrams(w, low, high)] for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), *(part.column(c) for c in rest)], ["grams", *rest])

    return df.mapInArrow(cut, T.StructType([T.StructField("grams", T.ArrayType(T.StringType())), *(df.schema[c] for c in rest)]))


#: Training rows that one task holds
ROWS_A_TASK = 5_000


#: CountVectorizer needs a bound; this one is beyond any corpus, so every n-gram of two texts or more counts
ALL_NGRAMS = 2**31 - 1


def fit(train: DataFrame, vocabulary: int = ALL_NGRAMS, iterations: int = 20) -> Model:
    """L1, L2: counts of n-grams in at least two texts, idf, unit length, a linear SVM with balanced class weights."""
    n = train.count()
    labels = train.groupBy("label").count()
    k = labels.count()
    weighted = train.join(F.broadcast(labels.withColumn("weight", F.lit(n) / (k * F.col("count"))).drop("count")), "label")  # a row a class
    # features once, in few partitions: every iteration of every class reads them
    parts = max(1, min(weighted.rdd.getNumPartitions(), n // ROWS_A_TASK + 1))
    grams = with_ngrams(weighted.select("text", F.col("label").cast("double").alias("label"), "weight")).coalesce(parts)
    counted = Pipeline(stages=[CountVectorizer(inputCol="grams", outputCol="tf", minDF=2.0, vocabSize=vocabulary), IDF(inputCol="tf", outputCol="unused")]).fit(grams)
    # the library's weights are ln((n + 1) / (df + 1)); the smoothed ones are greater by one
    weights = ElementwiseProduct(scalingVec=Vectors.dense(counted.stages[1].idf.toArray() + 1.0), inputCol="tf", outputCol="tfidf")
    features = PipelineModel([counted.stages[0], weights, Normalizer(inputCol="tfidf", outputCol="features")])
    ready = features.transform(grams).select("features", "label", "weight").persist()
    svm = LinearSVC(maxIter=iterations, regParam=1.0 / max(n, 1), weightCol="weight")
    model = OneVsRest(classifier=svm, weightCol="weight", parallelism=3).fit(ready)
    ready.unpersist()
    return PipelineModel([features, model])


def predictor(model: Model) -> Callable[[DataFrame], DataFrame]:
    """L4: a function that adds y_pred to rows with text."""
    return lambda df: model.transform(df.withColumn("grams", char_ngrams())).withColumn("y_pred", F.col("prediction").cast("int"))


def train_variant(train: DataFrame, variant: str, seed: int) -> DataFrame:
    """Half of the rows noised by a type of the variant's group at a severity of 1 to 3, both drawn by id."""
    if variant not in TRAIN_VARIANTS:
        raise ValueError(f"unknown train variant {variant!r}; one of {list(TRAIN_VARIANTS)} is needed")
    group = TRAIN_VARIANTS[variant]
    if group is None:
        return train
    types = maps.NOISE_GROUPS[group]
    u = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}\x1faugment\x1f{tag}\x1f"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = train.withColumns({"_on": u("on") < 0.5, "_type": F.element_at(F.array(*map(F.lit, types)), (F.floor(u("type") * len(types)) + 1).cast("int")), "_sev": (F.floor(u("sev") * 3) + 1).cast("int")})
    out = drawn.where("not _on").select(*train.columns)
    from .noise import perturb

    for t in types:
        own = drawn.where(F.col("_on") & (F.col("_type") == t))
        noised = perturb(own, t, [1, 2, 3], [seed]).where("severity = _sev")
        out = out.unionByName(noised.withColumn("text", F.col("noised")).select(*train.columns))
    return out


def evaluate_grid(test: DataFrame, predict: Callable[[DataFrame], DataFrame], severities: list[int], seed: int, types: list[str] = maps.NOISE_TYPES) -> DataFrame:
    """Metrics of every type and severity, and of the clean text, as one plan; texts are noised whole."""
    noisy = all_types(test, severities, [seed], types).withColumn("text", F.col("noised")).select(*test.columns, "noise_type", "severity")
    both = noisy.unionByName(test.withColumns({"noise_type": F.lit(""), "severity": F.lit(0)}))
    return summary(predict(both).withColumnRenamed("label", "y_true"), "noise_type", "severity")


def run_job(model: str, task: str, seed: int, variant: str, train: DataFrame, test: DataFrame, results: str, severities: list[int] = (1, 2, 3, 4, 5), types: list[str] = tuple(maps.NOISE_TYPES), normalizer: str = "on") -> bool:
    """One run from its rows to its results: nothing if all cells of the run are there, else augment, fit, evaluate
    on clean text and on the grid, and append the cells that are missing.  True if it ran."""
    from ..sources.sinks import append_results, exists

    spark, run_id = train.sparkSession, f"{model}__{task}__{seed}__{variant}"
    wanted = 1 + len(types) * len(severities)
    if exists(spark, results):
        done = spark.read.parquet(results).where((F.col("run_id") == run_id) & (F.col("normalizer") == normalizer)).select("noise_type", "severity").distinct().count()
        if done >= wanted:
            return False
    fitted = fit(train_variant(train, variant, seed).select("text", "label"))
    cells = evaluate_grid(test, predictor(fitted), list(severities), seed, list(types))
    named = {"run_id": run_id, "model": model, "task": task, "train_variant": variant, "normalizer": normalizer}
    out = cells.withColumns({k: F.lit(v) for k, v in named.items()}).withColumns({"seed": F.lit(seed), "timestamp": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    append_results(out.withColumn("noise_type", F.when(F.col("noise_type") == "", "none").otherwise(F.col("noise_type"))), results)
    return True


def squashed(score):
    """a decision value as a score between 0 and 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
