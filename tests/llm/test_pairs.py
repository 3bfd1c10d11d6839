import random
from itertools import combinations

import numpy as np
from shobdo.llm.consistent import Words
from shobdo.llm.leakage import FMIndex, Phrases, leaked_items, merge_spans, shard_hits, suffix_array
from shobdo.llm.neardup import NearDuplicates, suffix_filter
from shobdo.llm.overlap import CrossSplitOverlap, letters, overlap_report


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def _edited(words, rng, k):
    out = list(words)
    for _ in range(k):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [out[i] + "x"], [out[i], "new"]])
    return out


def _grams(t, n):
    w = Words([t]).strings()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_near_duplicates_equal_brute_force(spark):
    rng, vocab = random.Random(5), _words(300, 1)
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        texts += [" ".join(base), " ".join(_edited(base, rng, rng.randint(0, 6)))]
    texts += [texts[0]] * 20 + [None, "", "two words", "a b c", "a b c", " ".join(vocab * 30)]
    rows = [(i, t, 7, "g") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ref int, gram string")
    for n, t in ((3, 0.5), (5, 0.8)):
        sets = [_grams(x, n) if x else set() for x in texts]
        want = {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
        nd = NearDuplicates(df, n, t)
        assert {(r.doc_a, r.doc_b) for r in nd.pairs().collect()} == want
        classes = nd.classes().collect()
        assert len(classes) == sum(map(bool, sets)) and max(r.copies for r in classes) >= 21
    assert NearDuplicates(df.limit(0), 3, 0.5).pairs().count() == 0


def test_suffix_filter_never_drops_close_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, 25))
        b = np.unique(rng.integers(0, 60, 25))
        d = len(np.setxor1d(a, b))
        assert suffix_filter(a, b, d)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_cross_split_overlap_equals_brute_force(spark):
    rng, vocab = random.Random(8), _words(200, 2)
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 30))]
        variant = _edited(base, rng, rng.randint(0, 2))
        for text, split in ((" ".join(base), "train"), ("  ".join(variant).upper() + "!", rng.choice(["val", "test", "train"]))):
            rows.append((i, "d" if i % 7 else None, split, "s", text))
            i += 1
    rows += [(i + k, "d", s, "s", t) for k, (s, t) in enumerate([("train", None), ("val", ""), (None, "a b c d e f"), ("test", "one two"), ("train", "see https://x.y/z @bob one two three four"), ("val", "see www.other @al one two three four")])]
    rows += [(1000 + k, "d", "train" if k % 2 else "test", "s", "the same comment again and again") for k in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, dataset string, split string, source string, text string, ref int")
    live = [(r, letters(r[4])) for r in rows if r[4] and r[2] and Words([r[4]]).counts()[0] >= 5]
    want = set()
    for (a, x), (b, y) in combinations(live, 2):
        if (a[1] or "") == (b[1] or "") and (a[2] == "train") != (b[2] == "train") and _distance(x, y) <= 0.15 * max(len(x), len(y)):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert {(r.record_a, r.record_b) for r in CrossSplitOverlap(df).pairs().collect()} == want and len(want) > 230
    # other partitions, and heavy m-grams dealt to grids of them, change nothing
    spread = CrossSplitOverlap(df, n_buckets=130, heavy=8)
    assert {(r.record_a, r.record_b) for r in spread.pairs().collect()} == want
    classes = {r.record_id: r for r in spread.classes().collect()}
    assert set(classes) == {r[0] for r, _ in live} and sum(r.n_links > 0 for r in classes.values()) > 10
    assert all(r.distance > 0 and r.covered > 0 for r in spread.class_links().collect())
    report = overlap_report(df).collect()
    assert sum(r.n_rows for r in report) == sum(r[2] in ("val", "test") for r in rows) and all(r.n_equal <= r.n_overlapping <= r.n_rows for r in report)
    assert CrossSplitOverlap(df.limit(0)).pairs().count() == 0


def test_cross_split_overlap_of_large_families(spark):
    """Several hundred variants of one text, of equal length as well: every pair meets, not only neighbours."""
    rng, abc = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choice(abc) for _ in range(60))
    texts = set()
    while len(texts) < 320:
        t = list(base)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [rng.choice(abc)], [rng.choice(abc)], [rng.choice(abc)], [t[i], rng.choice(abc)]])
        texts.add("".join(t))
    texts = sorted(texts)
    rng.shuffle(texts)
    rows = [(i, "d", "test" if i % 3 == 0 else "train", "s", " ".join(t[k : k + 10] for k in range(0, len(t), 10))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id long, dataset string, split string, source string, text string")
    got = {(r.record_a, r.record_b) for r in CrossSplitOverlap(df).pairs().collect()}
    want = {(i, j) for i, j in combinations(range(320), 2) if (i % 3 == 0) != (j % 3 == 0) and _distance(texts[i], texts[j]) <= 0.15 * max(len(texts[i]), len(texts[j]))}
    assert len(want) > 22_000 and got == want


def test_cross_split_overlap_counts_spans_of_long_texts(spark):
    """75,000 letters whose edits lie in the first 65,535: the rest, shared, is covered by its own places."""
    rng = random.Random(6)
    a = [rng.choice("abcdefghijklm") for _ in range(75_000)]
    b = [x if i > 65_535 or i % 7 else "z" for i, x in enumerate(a)]
    rows = [(k, "d", s, "s", " ".join("".join(t[i : i + 9]) for i in range(0, len(t), 9))) for k, (s, t) in enumerate((("train", a), ("test", b)))]
    df = spark.createDataFrame(rows, "record_id long, dataset string, split string, source string, text string")
    assert CrossSplitOverlap(df).candidates.count() == 1


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n, sigma in ((0, 2), (1, 2), (50, 2), (200, 4)):
        s = rng.integers(1, sigma, n) if n else np.zeros(0, np.int64)
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        ix = FMIndex(s, sigma)
        pats = rng.integers(1, sigma, (30, 3))
        lo, hi = ix.search(pats)
        for p, a, b in zip(pats, lo, hi, strict=True):
            assert sorted(ix.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (s[i : i + 3] == p).all()]


def test_leaked_items(spark):
    w = _words(60, 4)
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:25])), (3, "too short"), (4, None), (5, ""), (1, " ".join(w[:20]))]
    docs = [(1, "intro " + " ".join(w[5:16]).upper() + ". end"), (2, " ".join(w[:9])), (3, "x " + ", ".join(w[10:20])), (4, None), (5, ""), (6, " ".join(w[5:14]) + " gap " + w[14])]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, item_id int")
    t = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    out = {(r.doc_id, r.item_id): r for r in leaked_items(d, t).collect()}
    assert set(out) == {(1, 1), (3, 1), (3, 2)}
    assert [(s.start, s.end) for s in out[1, 1].spans] == [(1, 12)] and out[3, 2].leaked_words == 10
    assert leaked_items(d, t.limit(0)).count() == 0 and leaked_items(d.limit(0), t).count() == 0
    assert merge_spans(np.array([5, 0, 3]), np.array([6, 4, 5])) == [(0, 6)]
    assert len(shard_hits(["a b"], Phrases([1], ["a"]))[1]) == 0
