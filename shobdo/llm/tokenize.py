"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

The corpus's most frequent units (a blank and the non-blank run after it) are compiled, with their ids, into a
minimal acyclic transducer: suffixes are shared, each arc carries the number of words that sort before it, and
the sum of those numbers along a path is the word's place in one flat array of ids.  The transducer goes to the
executors as one bounded file, which the workers map into memory; units it lacks are merged exactly.

Units are cut where the vocabulary's own pattern always cuts (before a blank that precedes a non-blank, around other
white space), so the ids are those of the whole text.  Defined results: empty and null text give the empty list;
special tokens' strings are ordinary text; any length.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, shared_file

TOKENIZERS = "/opt/tokenizers"
#: The lexicon's bound: this many units at most are compiled, sent and mapped, whatever the corpus's size.
LEXICON_WORDS = 32_768
#: Units longer than this are never compiled (they are merged like other unseen ones).
LEXICON_BYTES = 96
# Fixed value: the public pattern that cuts a text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WS = "\t-\r \x85\xa0  -     　"  # White_Space of Unicode
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: Code points of text looked up at a time, and ids given out at a time, to bound a worker's memory
BLOCK_CHARS, BLOCK_IDS = 4_000_000, 2_000_000


def units(text: str) -> list[str]:
    """Pieces whose separate encodings, put together, are the encoding of the text."""
    return _UNIT.findall(text)


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Transducer:
    """Minimal acyclic transducer over UTF-8 bytes in four arrays: key = state * 256 + byte of each arc in order,
    its target, its output, and which states end a word (a word that ends counts before the longer ones)."""

    def __init__(self, key: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray):
        self.key, self.target, self.skip, self.final = key, target, skip, final

    @classmethod
    def build(cls, words: list[bytes]) -> Transducer:
        """Incremental construction from sorted distinct words; equal right sides are merged by a register."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...)) of the frozen states
        path: list[list] = [[False, []]]  # the states of the last word that are not frozen yet

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                sig = (final, tuple(arcs))
                at = register.get(sig)
                if at is None:
                    at = register[sig] = len(states)
                    states.append(sig)
                label = path[-1][1][-1][0]
                path[-1][1][-1] = (label, at)

        last = b""
        for w in words:
            k = 0
            most = min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            freeze(k)
            for b in w[k:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        freeze(0)
        states.append((path[0][0], tuple(path[0][1])))
        n = len(states)
        # the root gets number 0: frozen numbers are turned round
        below = [0] * n  # words accepted from each state
        key, target, skip = [], [], []
        for i, (final, arcs) in enumerate(states):  # targets are frozen before their sources
            total = int(final)
            for b, t in arcs:
                key.append((n - 1 - i) * 256 + b)
                target.append(n - 1 - t)
                skip.append(total)
                total += below[t]
            below[i] = total
        order = np.argsort(np.array(key, np.int64), kind="stable") if key else np.zeros(0, np.int64)
        final = np.array([f for f, _ in reversed(states)], bool)
        as_ = lambda x, t: np.array(x, t)[order] if key else np.zeros(0, t)
        return cls(as_(key, np.int64), as_(target, np.int32), as_(skip, np.int32), final)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the sorted words, -1 if it is none: all words take a step at a time."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lengths) - lengths
        state, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, depth = np.arange(n), 0
        while len(self.key) and len(live):
            more = live[lengths[live] > depth]
            if not len(more):
                break
            k = state[more] * 256 + data[start[more] + depth]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            state[more[~hit]] = -1
            more, at = more[hit], at[hit]
            state[more] = self.target[at]
            place[more] += self.skip[at]
            live, depth = more, depth + 1
        ok = (state >= 0) & self.final[np.maximum(state, 0)]
        if not len(self.key):
            ok &= lengths == 0
        return np.where(ok, place, -1)


# ------------------------------------------------------------------ the lexicon, fitted on counts of all units


def _count_units(batches):
    c: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                c.update(_UNIT.findall(t))
        if len(c) > 300_000:  # bounds the memory; equal units meet again after the shuffle
            yield pa.RecordBatch.from_pydict({"unit": list(c), "n": list(c.values())})
            c.clear()
    if c:
        yield pa.RecordBatch.from_pydict({"unit": list(c), "n": list(c.values())})


def frequent_units(docs: DataFrame, size: int = LEXICON_WORDS) -> DataFrame:
    """unit, n: the most frequent units of all texts, counted before the shuffle and again after it."""
    counted = docs.select("text").mapInArrow(_count_units, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return counted.where((F.octet_length("unit") <= LEXICON_BYTES) & (F.col("n") > 1)).orderBy(F.desc("n"), "unit").limit(size)


def compile_lexicon(unit_list: list[str], vocabulary: str) -> dict[str, np.ndarray]:
    """Transducer arrays, and ids of all words as one flat array with offsets."""
    enc = encoder(vocabulary)
    words = sorted({u.encode("utf-8", "surrogatepass") for u in unit_list})
    fst = Transducer.build(words)
    ids = [enc.encode_ordinary(w.decode("utf-8", "surrogatepass")) for w in words]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return {
        "key": fst.key, "target": fst.target, "skip": fst.skip, "final": fst.final,
        "ids": np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]),
    }


_PARTS = ("key", "target", "skip", "final", "ids", "offsets")


def lexicon_bytes(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays after one another, with a header of their sizes; every array begins at a multiple of 64."""
    out = [np.array([len(parts[p]) for p in _PARTS], np.int64).tobytes().ljust(64, b"\0")]
    for p in _PARTS:
        raw = parts[p].tobytes()
        out.append(raw + b"\0" * (-len(raw) % 64))
    return b"".join(out)


_TYPES = {"key": np.int64, "target": np.int32, "skip": np.int32, "final": np.bool_, "ids": np.int32, "offsets": np.int64}


@lru_cache(maxsize=2)
def map_lexicon(path: str) -> tuple[Transducer, np.ndarray, np.ndarray]:
    sizes, at, parts = np.fromfile(path, np.int64, len(_PARTS)), 64, {}
    for p, n in zip(_PARTS, sizes.tolist(), strict=True):
        kind = np.dtype(_TYPES[p])
        parts[p] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
        at += n * kind.itemsize + (-(n * kind.itemsize) % 64)
    return Transducer(*(np.asarray(parts[p]) for p in _PARTS[:4])), parts["ids"], parts["offsets"]


# ------------------------------------------------------------------ encoding


def encode_block(texts: list[str | None], lexicon: tuple | None, vocabulary: str, most: int = BLOCK_IDS):
    """Yields (first, end, ids, offsets): the ids of texts[first:end] as one array and each text's offsets in it."""
    enc = encoder(vocabulary)
    found = [_UNIT.findall(t) if t else [] for t in texts]
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    flat = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
    index, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
    del found, flat
    n = len(distinct)
    lengths, start = np.zeros(n, np.int32), np.zeros(n, np.int32)
    known = np.zeros(0, np.int32)
    unseen = np.arange(n)
    if lexicon is not None and n:
        fst, known, offsets = lexicon
        place = fst.lookup([u.encode() for u in distinct])
        hit = place >= 0
        start[hit], lengths[hit] = offsets[place[hit]], offsets[place[hit] + 1] - offsets[place[hit]]
        unseen = np.flatnonzero(~hit)
    merged = [enc.encode_ordinary(distinct[i]) for i in unseen.tolist()]
    lengths[unseen] = np.fromiter(map(len, merged), np.int32, len(merged))
    start[unseen] = len(known) + np.cumsum(lengths[unseen]) - lengths[unseen]
    pool = np.concatenate([known, np.fromiter(chain.from_iterable(merged), np.int32, int(lengths[unseen].sum()))])
    ends = np.concatenate([[0], np.cumsum(lengths[index], dtype=np.int64)])
    bounds = ends[cuts]
    for first, end in blocks(np.diff(bounds).tolist(), most):
        # every unit's run of ids, copied in order
        own = index[cuts[first] : cuts[end]]
        each = lengths[own]
        at = start[own] - (ends[cuts[first] : cuts[end]] - bounds[first]).astype(np.int32)
        take = np.repeat(at, each)
        take += np.arange(len(take), dtype=np.int32)
        yield first, end, pool[take], (bounds[first : end + 1] - bounds[first]).astype(np.int32)


def encode_corpus(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids: the token ids of every text, as stored, without special tokens."""
    spark = docs.sparkSession
    name = None
    if lexicon_words:
        top = [r.unit for r in frequent_units(docs, lexicon_words).select("unit").collect()]  # bounded by lexicon_words
        name = f"lexicon-{uuid.uuid4().hex}.bin"
        spark.sparkContext.addFile(shared_file(spark, name, lexicon_bytes(compile_lexicon(top, vocabulary))))

    def encode(batches):
        lexicon = map_lexicon(SparkFiles.get(name)) if name else None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                for first, end, ids, bounds in encode_block(texts[a:b], lexicon, vocabulary):
                    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([keys.slice(a + first, end - first), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")
