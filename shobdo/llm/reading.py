"""Reading level of each document (problem 8): smoothed unigram language models, one per grade.

The unigrams of a text are its words and, for each sentence, its number of words as one more token.  A word's
probability under a grade is smoothed by a Dirichlet prior whose expectation is the grade's probability of the word's
length times the corpus's probability of the word given its length, so unseen words still speak through their length.
The level is the grade of highest posterior.

Training takes labelled documents (the median grade where readers disagree), at most `MOST_LABELLED` of them by hash of
the id; without any label a formula on word length seeds the grades.  The model keeps the `MOST_WORDS` most frequent words;
both bounds hold whatever the corpus's size, so the model can be sent to all executors.  Scoring reads every
document once and shuffles nothing.

Defined results: null, empty and blank texts get no row; a text without words gets the grade of highest prior; null
grades and grades outside 1 to 5 are ignored; any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_blocks
from .consistent import Words

GRADES = 5
MOST_LABELLED = 20_000
MOST_WORDS = 100_000
#: Strength of the prior in words
PRIOR = 1_000_000.0
LENGTHS, SENTENCES = 26, 41
_STOPS = np.array([ord(c) for c in ".!?।॥"], np.uint32)
# Mean word lengths (code points) that part the grades where no reader gave any
FORMULA = (4.6, 5.35, 6.35, 7.6)


def sentence_lengths(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and number of words of every sentence."""
    stop = np.isin(w.codes, _STOPS)
    before = np.concatenate([[0], np.cumsum(stop)])[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (w.doc[1:] != w.doc[:-1]))) if len(before) else np.zeros(0, np.int64)
    return w.doc[new], np.diff(np.append(new, len(before)))


def _count(batches):
    """kind 0: word by hash; 1: length of words; 2: length of sentences. Counted before the shuffle."""
    for batch in batches:
        texts, grades = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in text_blocks(texts):
            w = Words(texts[a:b])
            g = grades[a:b]
            out = []
            for kind, doc, value in (
                (0, w.doc, w.hash.view(np.int64)),
                (1, w.doc, np.minimum(w.end - w.start, LENGTHS - 1).astype(np.int64)),
                (2, *(lambda d, n: (d, np.minimum(n, SENTENCES - 1).astype(np.int64)))(*sentence_lengths(w))),
            ):
                if not len(doc):
                    continue
                distinct, index = np.unique(value, return_inverse=True)
                cell, n = np.unique(index * GRADES + g[doc] - 1, return_counts=True)
                value = distinct[cell // GRADES]
                length = np.zeros(len(cell), np.int64)
                if kind == 0:
                    where = np.zeros(len(distinct), np.int64)
                    where[index] = np.minimum(w.end - w.start, LENGTHS - 1)
                    length = where[cell // GRADES]
                out.append(pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(cell), pa.int32()), "value": value, "length": length, "grade": cell % GRADES + 1, "n": n}))
            yield from out


class GradeModel:
    """Log-probabilities of words, word lengths and sentence lengths by grade."""

    def __init__(self, priors: np.ndarray, words: np.ndarray, word_length: np.ndarray, counts: np.ndarray, lengths: np.ndarray, sentences: np.ndarray, strength: float = PRIOR):
        total = np.maximum(counts.sum(0), lengths.sum(0))  # words beyond the kept ones count as well
        p_length = (lengths + 0.5) / (lengths + 0.5).sum(0)
        everyday = lengths.sum(1) + 0.5
        given = counts.sum(1) / everyday[word_length]  # the corpus's probability of a word given its length
        order = np.argsort(words)
        self.words = words[order]
        smoothed = (counts + strength * p_length[word_length] * given[:, None]) / (total + strength)
        # relative to the length's probability, so that all words can start from their length
        self.extra = (np.log(smoothed) - np.log(p_length[word_length]) - np.log(given)[:, None])[order].astype(np.float32)
        self.lengths = np.log(p_length)
        self.sentences = np.log((sentences + 0.5) / (sentences + 0.5).sum(0))
        self.prior = np.log((priors + 0.5) / (priors + 0.5).sum())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Unnormalised log-posterior, a row a text."""
        w = Words(texts)
        out = np.tile(self.prior, (len(texts), 1))
        h = w.hash
        length = np.minimum(w.end - w.start, LENGTHS - 1)
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        sdoc, sn = sentence_lengths(w)
        sn = np.minimum(sn, SENTENCES - 1)
        for g in range(GRADES):
            v = self.lengths[length, g] + (np.where(known, self.extra[at, g], 0) if len(self.words) else 0)
            out[:, g] += np.bincount(w.doc, v, len(texts)) + np.bincount(sdoc, self.sentences[sn, g], len(texts))
        return out


def _labelled(docs: DataFrame, grades: DataFrame, most: int) -> DataFrame:
    by_doc = grades.where("doc_id is not null and grade between 1 and 5").groupBy("doc_id").agg(F.floor(F.median("grade") + 0.5).cast("int").alias("grade"))
    few = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").where("trim(text) <> ''").join(F.broadcast(few), "doc_id").select("text", "grade")


def _seeded(docs: DataFrame, most: int) -> DataFrame:
    few = docs.select("doc_id", "text").where("trim(text) <> ''").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    mean = F.length(F.regexp_replace("text", r"(?U)\s+", "")) / F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"(?U)\S+")))
    level = sum(((mean > c).cast("int") for c in FORMULA), F.lit(1))
    return few.select("text", level.alias("grade"))


def train(docs: DataFrame, grades: DataFrame, most_labelled: int = MOST_LABELLED, most_words: int = MOST_WORDS, strength: float = PRIOR) -> GradeModel:
    """The model of labelled documents; its counts are summed before they reach the driver and are bounded."""
    texts = cut(_labelled(docs, grades, most_labelled))  # read once, counted twice
    if texts.isEmpty():
        texts = cut(_seeded(docs, most_labelled))
    counted = texts.mapInArrow(_count, "kind int, value bigint, length bigint, grade bigint, n bigint")
    wide = counted.groupBy("kind", "value").agg(F.max("length").alias("length"), *(F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(1, GRADES + 1)))
    total = sum((F.col(f"g{g}") for g in range(2, GRADES + 1)), F.col("g1"))
    top = wide.orderBy(F.col("kind").desc(), total.desc(), "value").limit(most_words + LENGTHS + SENTENCES).toPandas()
    counts = top[[f"g{g}" for g in range(1, GRADES + 1)]].to_numpy(float)
    kind, value, length = top["kind"].to_numpy(), top["value"].to_numpy(np.int64), top["length"].to_numpy(np.int64)
    lengths, sentences = np.zeros((LENGTHS, GRADES)), np.zeros((SENTENCES, GRADES))
    lengths[value[kind == 1]] = counts[kind == 1]
    sentences[value[kind == 2]] = counts[kind == 2]
    priors = np.zeros(GRADES)
    for r in texts.groupBy("grade").count().collect():
        priors[r.grade - 1] = r["count"]
    words = kind == 0
    return GradeModel(priors, value[words].view(np.uint64), length[words], counts[words], lengths, sentences, strength)


def reading_levels(docs: DataFrame, model: GradeModel) -> DataFrame:
    """doc_id, level (1 easiest to 5), confidence (posterior of the level)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WORDS words

    def score(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = batch.column(0)
            for a, b in text_blocks(texts):
                s = sent.value.scores(texts[a:b])
                s -= s.max(1, keepdims=True)
                p = 1 / np.exp(s).sum(1)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array((s.argmax(1) + 1).astype(np.int32)), pa.array(p)], ["doc_id", "level", "confidence"])

    with_text = docs.select("doc_id", "text").where(F.col("text").rlike(r"(?U)\S"))
    return with_text.mapInArrow(score, "doc_id bigint, level int, confidence double")


def profile(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """source, category, level, n_docs."""
    return docs.select("doc_id", "source", "category").join(levels, "doc_id").groupBy("source", "category", "level").agg(F.count("*").alias("n_docs"))
