import os

import pytest
from shobdo.llm.reading import reading_levels, train
from shobdo.llm.tokenize import TOKENIZERS, Transducer, encode_corpus, encoder

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_transducer_numbers_its_words():
    words = sorted({w.encode() for w in ("a", "ab", "abc", "xbc", "bc", "", "কখ", "কগ", "zzz")})
    t = Transducer.build(words)
    assert t.lookup(words).tolist() == list(range(len(words)))
    assert t.lookup([b"x", b"abcd", b"zz", "ক".encode(), b"\xff"]).tolist() == [-1] * 5
    assert len(t.final) < 1 + sum(map(len, words))  # suffixes are shared
    assert Transducer.build([]).lookup([b"", b"a"]).tolist() == [-1, -1]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_ids_are_those_of_the_whole_text(spark):
    texts = ["আমি ভাত খাই। I'm  here\n\n 🔥 it's", "", None, "  a  b\n\n c\t", "   ", "\x1c x y", "<|endoftext|> don't 123", "x" * 5000, "আমি ভাত খাই। I'm"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    enc = encoder(VOCABULARY)
    for lexicon in (0, 3, 1000):
        out = {r.doc_id: r.ids for r in encode_corpus(df, VOCABULARY, lexicon).collect()}
        assert out == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), VOCABULARY).count() == 0


def test_levels_follow_labels(spark):
    easy, hard = "the cat sat on it. ", "antidisestablishmentarianism notwithstanding, incomprehensibilities counterrevolutionaries internationalization proliferate. "
    rows = [(i, (easy if i % 2 else hard) * (1 + i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, "  "), (103, "!!!"), (104, easy * 500)]
    docs = spark.createDataFrame([(*r, 3, "s", "c") for r in rows], "doc_id long, text string, level int, source string, category string")
    grades = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(40)] + [(0, "q", None), (1, "q", 9), (3, "q", 1)], "doc_id long, rater string, grade int")
    out = {r.doc_id: r.level for r in reading_levels(docs, train(docs, grades)).collect()}
    assert set(out) == set(range(60)) | {103, 104} and all(out[i] == (1 if i % 2 else 5) for i in range(60)) and out[104] == 1
    seeded = {r.doc_id: r.level for r in reading_levels(docs, train(docs, grades.limit(0))).collect()}
    assert seeded[0] > seeded[1]
    assert reading_levels(docs.limit(0), train(docs.limit(0), grades)).count() == 0


TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no test data")
def test_held_out_agreement(spark):
    """A fifth of the grades is held out: the levels agree with them better than those of word lengths alone."""
    from pyspark.sql import functions as F

    docs, grades = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/reading_grades.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    model = train(docs, grades.where(~held))
    test = grades.where(held & F.col("grade").between(1, 5)).join(docs.select("doc_id", "text"), "doc_id").where("trim(text) <> ''").toPandas()
    agree = lambda: (model.scores(test.text.tolist()).argmax(1) + 1 == test.grade).mean()
    full = agree()
    model.words = model.words[:0]
    lengths_and_sentences = agree()
    model.sentences[:] = 0
    assert full > 0.72 and full >= lengths_and_sentences - 0.02 and full > agree() + 0.02
