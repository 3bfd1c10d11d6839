import random
import unicodedata

import numpy as np
from shobdo.llm.consistent import Words, consistent
from shobdo.llm.lookalike import lookalike_pairs, spellings, with_consistent_text


def test_forms_that_look_the_same_meet():
    same = [
        ("рһоtо", "photo"), ("ＵΡＤΑΤＥ", "UPDATE"), ("résumé", "résumé"), ("a b c", "a b c"), ("প্রব​লেম", "প্রবলেম"),
        ("ড়", "ড়"), ("কো", "কো"), ("অামি", "আমি"), ("হঠাৎ", "হঠাত্‍"), ("ﬁnal", "final"), ("উ\u09a4\u09cd\u200dসব", "উৎসব"), ("СLIСНÉ", "CLICHÉ"),
    ]
    for a, b in same:
        assert consistent(a) == consistent(b), (a, b)


def test_visibly_different_texts_stay_apart():
    for a, b in [("Photo", "photo"), ("২", "2"), ("a.b", "a,b"), ("কী", "কি"), ("Ωmega", "omega"), ("“x”", '"x"'), ("ক্‌ষ", "ক্ষ")]:
        assert consistent(a) != consistent(b)
    assert consistent("Привет спасибо") == "Привет спасибо"


def test_idempotent_on_random_text():
    rng = random.Random(3)
    chars = "abcАВСоеρ০কখ্াি়‍‌­ é́ ﬁ①½"
    for _ in range(500):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 12)))
        assert consistent(consistent(t)) == consistent(t)


def test_words_agree_with_plain_definition():
    texts = ["(Hello), world!  ক…", "", None, "--- !!", "a\nb\tc", "।কী। 'x'", "word " * 2000]
    w = Words(texts)
    want = []
    for t in texts:
        for piece in (consistent(t) or "").lower().split():
            while piece and unicodedata.category(piece[0])[0] == "P":
                piece = piece[1:]
            while piece and unicodedata.category(piece[-1])[0] == "P":
                piece = piece[:-1]
            if piece:
                want.append(piece)
    assert w.strings() == want
    h = w.hash
    assert len(np.unique(h)) == len(set(want))
    assert all(h[i] == h[j] for i in range(8) for j in range(8) if want[i] == want[j])


def test_lookalike_pairs(spark):
    rows = [(1, "d", "photo"), (2, "d", "рһоtо"), (3, "d", "photo"), (4, "e", "рһоtо"), (5, "d", None), (6, "d", ""), (7, "d", " "), (8, "d", " "), (9, None, "x y"), (10, None, "x y")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "record_id long, dataset string, text string, form int, spelling string")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {(1, 2), (2, 3), (9, 10)}
    assert [(r.n_rows, r.n_spellings) for r in spellings(df).orderBy("n_rows").collect()] == [(2, 2), (3, 2)]
    out = with_consistent_text(df)
    assert {r.record_id: r.consistent_text for r in out.collect()}[5] is None
    assert lookalike_pairs(df.limit(0)).count() == 0
