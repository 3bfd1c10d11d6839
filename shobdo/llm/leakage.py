"""Evaluation texts leaking into training text (problem 7).

Each shard of the corpus (a block of one task's rows) gets an FM-index of its words: the Burrows-Wheeler
transform in a wavelet matrix, whose ranks drive the backward search of all test phrases at once, and suffix
positions sampled at every 16th place, from which occurrences are located.  Words that no test item has cannot be
part of a phrase; a run of them is one separator in the indexed text, as is the end of a document, and pieces
shorter than a phrase are left out.  Test items come in blocks of a bounded number of words, one pass over the
corpus a block; the corpus is never shuffled.

Defined results: null and short texts leak nothing; items of fewer than `run` words leak nothing; an item given
twice is reported under each id; equal documents are each reported; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_blocks
from .consistent import Words

#: Consecutive words that make a leak
RUN = 10
#: Words of test items searched in one pass over the corpus; more items take more passes
BLOCK_WORDS = 500_000
#: Every so many places of the indexed text keep their suffix position
SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (a shorter one first) by prefix doubling; only unsettled groups are sorted again."""
    n = len(s)
    rank = s.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    first = np.ones(n, bool)
    if n:
        first[1:] = rank[order[1:]] != rank[order[:-1]]
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while n and not first.all():
        # members of groups that have more than one suffix, still in their order
        open_ = ~first
        open_[:-1] |= ~first[1:]
        at = np.flatnonzero(open_)
        who = order[at]
        second = np.full(len(who), -1, np.int64)
        inside = who + step < n
        second[inside] = rank[who[inside] + step]
        by = np.lexsort((second, rank[who]))
        who, second = who[by], second[by]
        order[at] = who
        old = rank[who]
        new = np.ones(len(who), bool)
        new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        first[at] = new
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2
    return order


class FMIndex:
    """Counts and locates patterns in s, whose symbols are 1 and up; the end of s has symbol 0."""

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.append(s, 0).astype(np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.levels = []  # wavelet matrix: ones before each place, number of zeros
        cur = bwt
        for b in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (cur >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((b, ones, self.n - int(ones[-1])))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.bwt = bwt
        sampled = sa % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = sa[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols of the transform."""
        lo = np.zeros(len(i), np.int64)
        hi = i.astype(np.int64)
        for b, ones, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            o_lo, o_hi = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + o_lo, lo - o_lo), np.where(one, zeros + o_hi, hi - o_hi)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each pattern (a row of the matrix), by backward search of all at once."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in s of rows, walking back to the nearest sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        rows, live, steps = rows.copy(), np.arange(len(rows)), 0
        while len(live):
            r = rows[live]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[live[hit]] = self.samples[self.sampled[r[hit]]] + steps
            live, r = live[~hit], r[~hit]
            c = self.bwt[r]
            rows[live] = self.before[c] + self.rank(c, r)
            steps += 1
        return out


class Phrases:
    """All runs of words of a block of test items, in symbols of the block's own words (2 and up)."""

    def __init__(self, ids: list[int], texts: list[str | None], run: int = RUN):
        w = Words(texts)
        self.run = run
        self.vocabulary, symbol = np.unique(w.hash, return_inverse=True)
        n = len(symbol)
        start = np.arange(max(0, n - run + 1))
        start = start[w.doc[start] == w.doc[start + run - 1]] if len(start) else start
        rows = symbol[start[:, None] + np.arange(run)] + 2 if len(start) else np.zeros((0, run), np.int64)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        owner = np.unique(np.stack([which.reshape(-1), w.doc[start]]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
        self.owner_cut = np.searchsorted(owner[0], np.arange(len(self.patterns) + 1))
        self.owner = np.array(ids, np.int64)[owner[1]] if len(rows) else np.zeros(0, np.int64)
        self.sigma = len(self.vocabulary) + 2

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def shard_hits(texts: list[str | None], phrases: Phrases) -> tuple[Words, np.ndarray, np.ndarray]:
    """The shard's words; pattern number and place (in words) of every occurrence."""
    w = Words(texts)
    sym = phrases.symbols(w.hash)
    n, run = len(sym), phrases.run
    none = np.zeros(0, np.int64)
    if not n or not len(phrases.patterns):
        return w, none, none
    # pieces: maximal runs of known words within a document
    begin = np.ones(n, bool)
    begin[1:] = (w.doc[1:] != w.doc[:-1]) | (sym[1:] == 1) | (sym[:-1] == 1)
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, n))
    keep = (size >= run) & (sym[first] != 1)
    first, size = first[keep], size[keep]
    if not len(first):
        return w, none, none
    # a separator (1) after every piece
    total = int((size + 1).sum())
    at = np.arange(total) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    word = np.repeat(first, size + 1) + at
    text = np.where(at == np.repeat(size, size + 1), 1, sym[np.minimum(word, n - 1)])
    index = FMIndex(text, phrases.sigma)
    lo, hi = index.search(phrases.patterns)
    count = hi - lo
    pattern = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[pattern]
    return w, pattern, word[index.locate(rows)]


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("leaked_words", pa.int32()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _item_blocks(items: DataFrame, run: int) -> Iterator[Phrases]:
    """Blocks of items of a bounded size; the rows stream through the driver a partition at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += r.text.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield Phrases(ids, texts, run)
            ids, texts, size = [], [], 0
    if ids:
        yield Phrases(ids, texts, run)


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id, n_words, leaked_words, spans: one row a document and leaked item.

    spans are merged word ranges [start, end) of the document that hold the item's passages, ready for removal.
    """
    spark = docs.sparkSession

    def one(phrases: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)  # at most BLOCK_WORDS words

        def find(batches):
            p = sent.value
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_blocks(texts):
                    w, pattern, place = shard_hits(texts[a:b], p)
                    if not len(pattern):
                        continue
                    counts = w.counts()
                    offset = np.cumsum(counts) - counts
                    n_own = p.owner_cut[pattern + 1] - p.owner_cut[pattern]
                    hit = np.repeat(np.arange(len(pattern)), n_own)
                    k = np.arange(len(hit)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
                    item = p.owner[p.owner_cut[pattern[hit]] + k]
                    doc = w.doc[place[hit]]
                    start = place[hit] - offset[doc]
                    by = np.lexsort((start, item, doc))
                    doc, item, start = doc[by], item[by], start[by]
                    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
                    rows = []
                    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
                        spans = merge_spans(start[i:j], start[i:j] + p.run)
                        key = keys[a + int(doc[i])]
                        rows.append((key, int(item[i]), int(counts[doc[i]]), sum(y - x for x, y in spans), [{"start": x, "end": y} for x, y in spans]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        schema = "doc_id bigint, item_id bigint, n_words int, leaked_words int, spans array<struct<start:int,end:int>>"
        return docs.select("doc_id", "text").where("text is not null").mapInArrow(find, schema)

    found = [one(p) for p in _item_blocks(items, run)]
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_words int, leaked_words int, spans array<struct<start:int,end:int>>")
    return reduce(DataFrame.unionByName, found)
