"""Same or nearly the same records across splits (problem 1): a suffix array over partitioned texts.

1. Texts are reduced to their letters, marks and digits; equal ones are one class.  Every suffix goes to the partition of
   the least m-gram (by hash) of its first letters, so suffixes with a common prefix of the span's length share a
   partition.  Neighbouring suffixes mostly have that m-gram in common and travel as one stretch of text: some
   four bytes a suffix.
2. A partition sorts its suffixes by their letters and takes the common prefixes of neighbours.  All train and other
   suffixes whose common prefix is at least the span, at places that the distance allows, are shared spans; they are
   given where they begin and where stretches do, with their length.
3. Spans are merged into the letters that each pair of records covers; `COVERAGE` of the longer text is asked for.
4. Pairs are left to the edit distance, banded, once per pair of classes, unless their letter counts already rule them out.

The span is long for long texts (`SPANS`): the longest unbroken run of a text grows with its length.

Heavy m-grams (a footer or slogan in a large share of the rows) are found in a bounded sample, which decides nothing
but the partitioning: their train and other suffixes are dealt to the rows and columns of a grid of partitions.

Defined results: rows without text, split or id and texts of fewer than five words never count; a null dataset
is a dataset; equal texts pair; copies of one text stand for one class whose members are written out at the end; any
length.  What is found: every pair within the distance that shares an unbroken run of the span's length, 3 letters
where the shorter text has fewer than 16 (which every pair of such texts within the distance does), 6 below 32, 10
below 128, 14 below 256 and 18 beyond, if its runs of that length make up COVERAGE of the longer text (which one run does up
to 100, 140 or 180 letters).  No group is capped; pairs whose edits are spread so evenly that such runs are missing are not proposed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, cut, dropped, text_blocks, written
from .consistent import Words, codes, consistent, mix

MOST_EDITS = 0.15
#: Least length of the shorter text, span in letters
SPANS = ((1, 3), (16, 6), (32, 10), (128, 14), (256, 18))
#: Letters of the m-grams that decide the partition
GRAM = 5
#: Suffixes of one stretch
STRETCH = 200
#: Lengths of one pair are in one band or in neighbouring ones; bands of a prefix
_BAND, _BANDS = -np.log(1 - MOST_EDITS - 1e-3), 256
#: Pairs of suffixes that are looked at together, which bounds memory
PAIRS_AT_ONCE = 1_000_000
#: Least share of the longer text that shared spans cover
COVERAGE = 0.1
LEAST_WORDS = 5
#: Texts of the sample that looks for heavy m-grams, and stretches of one m-gram that a partition should hold of each side
SAMPLE, HEAVY = 20_000, 2_000_000
#: Candidate texts are fetched by a broadcast of their ids up to this number, by a shuffle beyond it
MOST_SENT_IDS = 1_000_000
_URL = re.compile(r"\b(?:https?://|www\.)\S+", re.IGNORECASE)
_MENTION = re.compile(r"(?<![\w@])@[\wঀ-৿]+")
_NUMBERS = (("doc", np.uint16), ("place", np.uint32), ("len", np.uint32), ("check", np.uint32), ("n", np.uint8))

_MESSAGE = "bucket int, kind int, side int, ds bigint, letters binary, numbers binary, ref bigint, record_id bigint, class_key bigint, bag bigint"
_MESSAGE_ARROW = pa.schema(
    [
        ("bucket", pa.int32()), ("kind", pa.int32()), ("side", pa.int32()), ("ds", pa.int64()), ("letters", pa.binary()), ("numbers", pa.binary()),
        ("ref", pa.int64()), ("record_id", pa.int64()), ("class_key", pa.int64()), ("bag", pa.int64()),
    ]
)
_SPANNED = "part int, ref bigint, record_id bigint, class_key bigint, side int, bag bigint, refs binary, others binary, places binary, runs binary, lens binary"
_SPANNED_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("ref", pa.int64()), ("record_id", pa.int64()), ("class_key", pa.int64()), ("side", pa.int32()), ("bag", pa.int64()),
        ("refs", pa.binary()), ("others", pa.binary()), ("places", pa.binary()), ("runs", pa.binary()), ("lens", pa.binary()),
    ]
)
_FOUND = "ref bigint, other bigint, covered int, longer int, record_id bigint, class_key bigint, side int, bag bigint"
_FOUND_ARROW = pa.schema(
    [
        ("ref", pa.int64()), ("other", pa.int64()), ("covered", pa.int32()), ("longer", pa.int32()), ("record_id", pa.int64()), ("class_key", pa.int64()),
        ("side", pa.int32()), ("bag", pa.int64()),
    ]
)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    out = np.zeros(0x30000, bool)
    for i in range(0x30000):
        c = unicodedata.category(chr(i))
        out[i] = c[0] in "LM" or c == "Nd"
    return out


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    """One byte a letter: ASCII, the Bengali block, and a hash into the rest, whose collisions only add candidates."""
    i = np.arange(0x30000)
    rest = np.array([b for b in range(1, 128) if not chr(b).isalnum() and b != 10], np.uint8)
    out = rest[(mix(i.astype(np.uint64)) % np.uint64(len(rest))).astype(np.int64)]
    out[:128] = i[:128]
    out[0x980:0xA00] = i[0x980:0xA00] - 0x980 + 128
    out[10] = 0
    return out


def _masked(text: str) -> str:
    """Links and mentions replaced as the cleaning does."""
    if "http" in text or "www." in text:
        text = _URL.sub("<url>", text)
    return _MENTION.sub("<user>", text) if "@" in text else text


def letters(text: str) -> str:
    """What is compared: letters, marks and digits of the consistent form in lower case, links and mentions masked."""
    k = _kept()
    return "".join([c for c in _masked((consistent(text) or "").lower()) if ord(c) < 0x30000 and k[ord(c)]])


class _Block:
    """Letters of a block of texts as code points, a line feed before and after each, with start and length."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts)
        enough = w.counts() >= LEAST_WORDS
        lines = w.joined.split("\n")
        c = codes("\n" + "\n".join([_masked(t) if e else "" for t, e in zip(lines, enough.tolist(), strict=True)]) + "\n")
        c = c[_kept()[np.minimum(c, 0x2FFFF)] | (c == 10)]
        ends = np.flatnonzero(c == 10)
        self.codes = c
        self.start = ends[:-1] + 1
        self.len = ends[1:] - self.start
        self.enough = enough & (self.len > 0)
        mixed = mix(c.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        # hash of the whole text, from its letters in order
        weight = mix(np.arange(int(self.len.max()) + 1 if len(self.len) else 1, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
        doc = np.repeat(np.arange(len(texts)), self.len)
        inside = np.flatnonzero(c != 10)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed[inside] * weight[inside - self.start[doc]], dtype=np.uint64)])
        end = np.cumsum(self.len)
        self.key = mix(sums[end] - sums[end - self.len] + self.len.astype(np.uint64))
        self.mixed = mixed

    def bags(self, docs: np.ndarray) -> np.ndarray:
        """Letters by their hash in 16 bins, four bits a bin: counts modulo 16."""
        at = np.repeat(np.arange(len(docs)), self.len[docs]) * 16
        c = self.mixed[_ranges(self.start[docs], self.len[docs])] >> np.uint64(60)
        counts = np.bincount(at + c.astype(np.int64), minlength=16 * len(docs)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
        return (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)

    def stretches(self, docs: np.ndarray, span: int):
        """doc, place, number of suffixes, m-gram of the stretches of some texts, and where their letters are."""
        at = _ranges(self.start[docs] - 1, self.len[docs] + 1)  # each text behind its line feed
        doc = np.repeat(docs, self.len[docs] + 1)
        mixed, m = self.mixed[at], min(GRAM, span)
        n = len(at) - span + 1
        if n <= 0:
            return None
        h = np.zeros(len(at) - m + 1, np.uint64)
        for k in range(m):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : len(h) + k]
        least = _sliding_min(mix(h), span - m + 1)
        own = (doc[:n] == doc[span - 1 :]) & (self.codes[at[:n]] != 10)
        new = own.copy()
        new[1:] &= ~own[:-1] | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            return None
        size = np.add.reduceat(own.astype(np.int64), begin)
        parts = -(-size // STRETCH)
        j = _ranges(np.zeros(len(begin), np.int64), parts)
        begin, size = np.repeat(begin, parts) + j * STRETCH, np.minimum(np.repeat(size, parts) - j * STRETCH, STRETCH)
        d = doc[begin]
        return d, at[begin] - self.start[d], size, least[begin], at[begin] - 1


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each size, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def _kinds(length: np.ndarray):
    """Kind by kind the texts that take part: those of its lengths, and longer ones that may pair with them."""
    for kind, (least, span) in enumerate(SPANS):
        end = SPANS[kind + 1][0] if kind + 1 < len(SPANS) else None
        yield kind, span, (length >= max(least, span)) & ((length < end / (1 - MOST_EDITS) + 1) if end else True)


def _salts(dataset: list[str | None]) -> np.ndarray:
    names, at = np.unique([d or "" for d in dataset], return_inverse=True)
    return np.array([mix(codes(x + "\n").astype(np.uint64) + np.arange(len(x) + 1, dtype=np.uint64) * np.uint64(1 << 40)).sum() for x in names.tolist()], np.uint64)[at]


def _packed(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _messages(rows: dict, base: int, n_buckets: int, heavy: dict[int, int]) -> pa.RecordBatch:
    b = _Block(rows["text"])
    side = np.array([s != "train" for s in rows["split"]], np.int64)
    salt = _salts(rows["dataset"])
    key = mix(b.key ^ mix(salt))
    out: list[tuple] = []
    has = np.flatnonzero(b.enough)
    # one of the equal texts of a split sends its suffixes
    _, first = np.unique(key[has] ^ side[has].astype(np.uint64), return_index=True)
    sender = np.zeros(len(key), bool)
    sender[has[first]] = True
    bag = dict(zip(has[first].tolist(), b.bags(has[first]).tolist(), strict=True))
    for d, k in zip(has.tolist(), key[has].view(np.int64).tolist(), strict=True):
        sends = sender[d]
        out.append((k % n_buckets, -1, int(side[d]), None, None, None, base + d if sends else -1, rows["record_id"][d], k, bag.get(d) if sends else None))
    letter = _bytes()[np.minimum(b.codes, 0x2FFFF)]
    for kind, span, wanted in _kinds(b.len):
        found = b.stretches(np.flatnonzero(wanted & sender), span)
        if found is None:
            continue
        doc, place, n, gram, at = found
        gram = mix(gram ^ salt[doc])
        cell = np.zeros(len(doc), np.uint64)
        if heavy:
            # a heavy m-gram has a grid of cells: train texts are dealt to its rows and other texts to its columns
            known = np.array(sorted(heavy), np.uint64)
            grid = np.array([heavy[k] for k in sorted(heavy)], np.int64)
            hit = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            size = np.where(known[hit] == gram, grid[hit], 1)
            j = _ranges(np.zeros(len(doc), np.int64), size).astype(np.uint64)
            doc, place, n, gram, at, size = (np.repeat(x, size) for x in (doc, place, n, gram, at, size))
            size = size.astype(np.uint64)
            own = mix(key[doc]) % size
            cell = np.where(side[doc] == 0, own * size + j, j * size + own)
        bucket = (mix(gram + cell * np.uint64(0xA0761D6478BD642F)) % np.uint64(n_buckets)).astype(np.int64)
        by = np.lexsort((salt[doc], side[doc], bucket))
        doc, place, n, at, bucket = doc[by], place[by], n[by], at[by], bucket[by]
        change = (bucket[1:] != bucket[:-1]) | (side[doc[1:]] != side[doc[:-1]]) | (salt[doc[1:]] != salt[doc[:-1]])
        cuts = np.append(np.flatnonzero(np.append(True, change)), len(doc))
        size = n + span  # the letter before, and all letters of its suffixes' spans
        text = letter[_ranges(at, size)]
        ends = np.append(0, np.cumsum(size))
        numbers = {"doc": doc, "place": place, "len": b.len[doc], "check": key[doc] & np.uint64(0xFFFFFFFF), "n": n}
        for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            planes = b"".join([_planes(numbers[c][x:y].astype(t)) for c, t in _NUMBERS])
            d = doc[x]
            out.append((int(bucket[x]), kind, int(side[d]), int(salt[d].view(np.int64)), compress(text[ends[x] : ends[y]].tobytes()), compress(planes), base, None, None, None))
    return _packed(out, _MESSAGE_ARROW)


_zstd = lru_cache(maxsize=1)(lambda: (zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()))


def compress(data: bytes) -> bytes:
    """Letters need some four bits each, which the shuffle's own compression does not see."""
    return _zstd()[0].compress(data)


def decompress(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one order together, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _numbers(data: bytes) -> list[np.ndarray]:
    each = sum(np.dtype(t).itemsize for _, t in _NUMBERS)
    size, at, out = len(data) // each, 0, []
    for _, t in _NUMBERS:
        width = np.dtype(t).itemsize * size
        out.append(_unplaned(data[at : at + width], t).astype(np.int64))
        at += width
    return out


def _table(schema: pa.Schema, **cols) -> pa.Table:
    size = len(next(iter(cols.values())))
    return pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)


class _Suffixes:
    """The suffixes of one partition whose first `span` letters both sides have, sorted by their letters."""

    def __init__(self, rows: list[dict], span: int):
        self.span = span
        text = np.frombuffer(b"".join([decompress(r["letters"]) for r in rows]), np.uint8)
        numbers = [_numbers(decompress(r["numbers"])) for r in rows]
        doc, place, length, check, n = (np.concatenate(x) for x in zip(*numbers, strict=True))
        per_row = [len(x[0]) for x in numbers]
        ref = np.repeat(np.array([r["ref"] for r in rows], np.int64), per_row) + doc
        side = np.repeat(np.array([r["side"] for r in rows], np.int64), per_row)
        size = n + span
        begin = np.cumsum(size) - size + 1
        stretch = np.repeat(np.arange(len(n)), n)
        inner = _ranges(np.zeros(len(n), np.int64), n)
        at = begin[stretch] + inner
        # eight letters to the word, as a big-endian number
        padded = np.concatenate([text, np.zeros(40, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(text) + 32, np.uint64)
        for k in range(8):
            word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)
        # suffixes whose prefix one side only has go first
        h, left = np.zeros(len(at), np.uint64), span
        for k in range(0, span, 8):
            x = word[at + k]
            if left < 8:
                x = x >> np.uint64(64 - 8 * left)
            h, left = mix(h + x), left - 8
        by = np.argsort(h)
        h = h[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        other = np.add.reduceat(side[stretch[by]], first) if len(h) else count
        by = by[np.repeat((other > 0) & (other < count), count)]
        at, stretch, inner = at[by], stretch[by], inner[by]
        rest = n[stretch] - inner + span - 1  # letters that the stretch has of the suffix
        words = [np.where(rest - k >= 8, word[at + k], word[at + k] & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.clip(rest - k, 0, 7)).astype(np.uint64))) for k in (0, 8, 16, 24)]
        place, length = place[stretch] + inner, length[stretch]
        by = np.lexsort((check[stretch], place, length, side[stretch], *words[::-1]))
        self.words = [x[by] for x in words]
        self.rest, self.place, self.len, self.side, self.ref = rest[by], place[by], length[by], side[stretch[by]], ref[stretch[by]]
        self.starts, self.before = inner[by] == 0, text[at[by] - 1]
        check = check[stretch[by]]
        self.common = self.prefix(np.arange(len(by) - 1), np.arange(1, len(by))) if len(by) else np.zeros(0, np.int64)
        # copies of one text in other blocks say nothing new
        same = np.zeros(len(by), bool)
        if len(by):
            same[1:] = self.common >= span
            for x in (check, self.place, self.len, self.side):
                same[1:] &= x[1:] == x[:-1]
        self.group = np.cumsum(np.append(False, self.common < span)) if len(by) else np.zeros(0, np.int64)
        for name in ("rest", "place", "len", "side", "ref", "starts", "before", "group"):
            setattr(self, name, getattr(self, name)[~same])
        self.words = [x[~same] for x in self.words]

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that two suffixes have in common at their beginning, at most 32."""
        out, going = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for w in self.words:
            x = w[i] ^ w[j]
            same = np.full(len(x), 8)
            for k in range(7, -1, -1):
                same[(x >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0] = k
            out += np.where(going, same, 0)
            going &= same == 8
        return np.minimum(out, np.minimum(self.rest[i], self.rest[j]))

    def meetings(self, shorter_below: int | None):
        """Chunks of (train suffixes, other suffixes) with the span in common at compatible places: all of them,
        however many; others are sorted by group, band of length and place, and a partner is in the same or a next band."""
        s, p, n = self.side, self.place, self.len
        cell = self.group * _BANDS + 1 + (np.log(np.maximum(n, 1)) / _BAND).astype(np.int64)
        train, other = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
        where = (cell[other] << 32) + p[other]
        by = np.argsort(where)
        where, other = where[by], other[by]
        window = (MOST_EDITS / (1 - MOST_EDITS) * n[train]).astype(np.int64) + 1
        for band in (-1, 0, 1):
            c = (cell[train] + band) << 32
            lo = np.searchsorted(where, c + np.maximum(p[train] - window, 0))
            count = np.searchsorted(where, c + p[train] + window, "right") - lo
            ends = np.cumsum(count)
            x = 0
            while x < len(train):
                y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS_AT_ONCE, "right")))
                k = count[x:y]
                i = np.repeat(train[x:y], k)
                j = other[_ranges(lo[x:y], k)]
                ok = (self.before[i] != self.before[j]) | (self.before[i] == 0) | self.starts[i] | self.starts[j]
                i, j = i[ok], j[ok]
                ok = np.abs(p[i] - p[j]) + np.abs((n[i] - p[i]) - (n[j] - p[j])) <= MOST_EDITS * np.maximum(n[i], n[j])
                if shorter_below:
                    ok &= np.minimum(n[i], n[j]) < shorter_below
                yield i[ok], j[ok]
                x = y


def _shared_spans(table: pa.Table, n_parts: int) -> pa.Table:
    """Shared spans (train text, other text, place, length) of one partition, packed by part of the other text."""
    kind = table["kind"].to_numpy()
    out = []
    members = table.filter(pa.array(kind < 0))
    if members.num_rows:
        out.append(_table(_SPANNED_ARROW, part=members["bucket"].combine_chunks(), **{c: members[c].combine_chunks() for c in ("ref", "record_id", "class_key", "side", "bag")}))
    for k, (_, span) in enumerate(SPANS):
        sent = table.filter(pa.array(kind == k)).select(["side", "ds", "letters", "numbers", "ref"]).to_pylist()
        for ds in {r["ds"] for r in sent}:
            s = _Suffixes([r for r in sent if r["ds"] == ds], span)
            part = (mix(s.ref.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
            for i, j in s.meetings(SPANS[k + 1][0] if k + 1 < len(SPANS) else None):
                if not len(i):
                    continue
                order = np.argsort(part[j], kind="stable")
                i, j = i[order], j[order]
                parts, begin = np.unique(part[j], return_index=True)
                cols = {"refs": s.ref[i], "others": s.ref[j], "places": s.place[j].astype(np.uint32), "runs": s.prefix(i, j).astype(np.uint8), "lens": np.maximum(s.len[i], s.len[j]).astype(np.uint32)}
                cuts = [*begin.tolist(), len(i)]
                out.append(_table(_SPANNED_ARROW, part=parts, **{c: [compress(_planes(x[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)] for c, x in cols.items()}))
    return pa.concat_tables(out) if out else _SPANNED_ARROW.empty_table()


def _covered(table: pa.Table) -> pa.Table:
    """Members as they are, and the pairs of one part with the letters of the other text that their merged spans cover."""
    packed = table["refs"].is_valid()
    members, spans = table.filter(pa.compute.invert(packed)), table.filter(packed)
    out = [_table(_FOUND_ARROW, **{c: members[c].combine_chunks() for c in ("ref", "record_id", "class_key", "side", "bag")})]
    if spans.num_rows:
        columns = (("refs", np.int64), ("others", np.int64), ("places", np.uint32), ("runs", np.uint8), ("lens", np.uint32))
        ref, other, place, run, longer = (np.concatenate([_unplaned(decompress(b), t) for b in spans[c].to_pylist()]) for c, t in columns)
        by = np.lexsort((place, other, ref))
        ref, other, place, run = ref[by], other[by], place[by].astype(np.int64), run[by].astype(np.int64)
        new = np.append(True, (ref[1:] != ref[:-1]) | (other[1:] != other[:-1]))
        pair = np.cumsum(new) - 1
        # ends so far within the pair: pairs are told apart by their number in the upper bits
        reach = np.maximum.accumulate((pair << 32) + place + run)
        before = np.append(0, reach[:-1])
        adds = reach - np.maximum((pair << 32) + place, before)
        begin = np.flatnonzero(new)
        covered = np.add.reduceat(np.maximum(adds, 0), begin)
        enough = covered >= COVERAGE * longer[by[begin]]
        begin, covered = begin[enough], covered[enough]
        out.append(_table(_FOUND_ARROW, ref=ref[begin], other=other[begin], covered=covered, longer=longer[by[begin]]))
    return pa.concat_tables(out)


def _possible(batches):
    """Pairs whose letter counts allow the distance: an edit changes one bin by one, or two.

    Counts are known modulo 16, and so are their differences, of which the least in size is taken; only more pairs pass for it."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy().view(np.uint8) for k in (2, 3))
        most = 2 * np.floor(MOST_EDITS * batch.column(5).to_numpy() + 1e-9)
        total = np.zeros(batch.num_rows, np.int64)
        for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
            d = (x - y) & 15
            total += np.minimum(d, 16 - d).astype(np.int64).reshape(-1, 8).sum(1)
        yield batch.select([0, 1, 4]).filter(pa.array(total <= most))


@F.pandas_udf(T.StringType())
def _letters_udf(s: pd.Series) -> pd.Series:
    return s.map(letters)


def heavy_grams(src: DataFrame, total: int, most: int = HEAVY) -> dict[int, int]:
    """Side of the grid of every m-gram whose stretches are too many for a partition, by a sample of the texts.

    The sample decides only where suffixes meet, never which."""
    if total < most:
        return {}  # a text would have to repeat an m-gram to have more stretches than there are texts

    def grams(batches):
        for batch in batches:
            d = batch.to_pydict()
            for a, z in text_blocks(d["text"]):
                b, salt = _Block(d["text"][a:z]), _salts(d["dataset"][a:z])
                for _, span, wanted in _kinds(b.len):
                    found = b.stretches(np.flatnonzero(wanted & b.enough), span)
                    if found is not None:
                        gram, n = np.unique(mix(found[3] ^ salt[found[0]]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    share = min(1.0, SAMPLE / total)
    counted = src.sample(share, 7).select("dataset", "text").mapInArrow(grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # stretches of the sample bound the rows that come back: each stands for `most` stretches at least
    found = counted.where(F.col("n") / share >= most).collect()
    return {r.gram % (1 << 64): int(np.ceil(r.n / share / most)) for r in found}


class CrossSplitOverlap:
    """members: record_id, class_key, side (0 train, 1 val or test).  links: class pairs within the distance, with the
    letters their shared spans cover."""

    def __init__(self, records: DataFrame, n_buckets: int | None = None, heavy: int = HEAVY):
        src = records.select("record_id", "dataset", "split", "text").where("text is not null and record_id is not null and split in ('train', 'val', 'test')")
        count, n_buckets_ = bucket_count(src)
        n_buckets = n_buckets or n_buckets_
        grid = heavy_grams(src, count, heavy)

        def send(batches):
            base = TaskContext.get().partitionId() << 40
            for batch in batches:
                d = batch.to_pydict()
                for a, b in text_blocks(d["text"]):
                    for i in range(a, b, 1 << 16):  # texts of a block have 16 bits
                        j = min(b, i + (1 << 16))
                        yield _messages({k: v[i:j] for k, v in d.items()}, base, n_buckets, grid)
                        base += 1 << 16

        def spans(table: pa.Table) -> pa.Table:
            return _shared_spans(table, n_buckets)

        shared = src.mapInArrow(send, _MESSAGE).groupBy("bucket").applyInArrow(spans, _SPANNED)
        found = written(shared.groupBy("part").applyInArrow(_covered, _FOUND), "spans")
        docs = found.where("other is null")
        self.members = docs.select("record_id", "class_key", "side")
        near = found.where("other is not null").select("ref", "other", "covered", "longer")
        senders = docs.where("ref >= 0").select("ref", "class_key", "bag")
        x = senders.select("ref", F.col("class_key").alias("x"), F.col("bag").alias("bx"))
        y = senders.select(F.col("ref").alias("other"), F.col("class_key").alias("y"), F.col("bag").alias("by"))
        pairs = near.join(x, "ref").join(y, "other").where("x <> y").select("x", "y", "bx", "by", "covered", "longer")
        pairs = pairs.mapInArrow(_possible, "x bigint, y bigint, covered int")
        self.candidates = written(pairs.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("covered").alias("covered")), "candidates")
        self.records = records

    @cached_property
    def links(self) -> DataFrame:
        """x, y, distance, covered: the candidates within the distance (checkpointed, so that their texts can be deleted)."""
        records = self.records
        ends = self.candidates.select(F.col("x").alias("class_key")).unionByName(self.candidates.select(F.col("y").alias("class_key"))).distinct()
        reps = ends.join(self.members.groupBy("class_key").agg(F.min("record_id").alias("record_id")), "class_key")
        reps = written(reps.select("record_id", "class_key"), "representatives")
        few = F.broadcast(reps) if reps.count() <= MOST_SENT_IDS else reps
        texts = written(records.select("record_id", "text").join(few, "record_id").select("class_key", _letters_udf("text").alias("t")), "letters")
        full = self.candidates.join(texts.select(F.col("class_key").alias("x"), F.col("t").alias("tx")), "x").join(texts.select(F.col("class_key").alias("y"), F.col("t").alias("ty")), "y")
        longer = F.greatest(F.length("tx"), F.length("ty"))
        most = F.floor(F.lit(MOST_EDITS) * longer + 1e-9).cast("int")
        full = full.withColumn("most", most).where(F.abs(F.length("tx") - F.length("ty")) <= F.col("most"))
        distance = F.expr("levenshtein(tx, ty, most)")
        out = cut(full.withColumn("distance", distance).where("distance >= 0").select("x", "y", "distance", "covered"))
        dropped(reps, texts)
        return out

    def pairs(self) -> DataFrame:
        """record_a < record_b, distance: one in train and one in val or test, classes written out."""
        m = self.members
        train = m.where("side = 0").select(F.col("class_key").alias("x"), F.col("record_id").alias("a"))
        other = m.where("side = 1").select(F.col("class_key").alias("y"), F.col("record_id").alias("b"))
        both = self.links.unionByName(self.links.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance", "covered"))
        near = both.join(train, "x").join(other, "y").select("a", "b", "distance")
        equal = train.join(other, F.col("x") == F.col("y")).select("a", "b", F.lit(0).alias("distance"))
        out = near.unionByName(equal)
        return out.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"), "distance")

    def classes(self) -> DataFrame:
        """record_id, class_id (the least record_id of the text), side, n_links: one row a record of five words or more; links
        are to other texts of the other side, and `class_links` has them."""
        ids = self.members.groupBy("class_key").agg(F.min("record_id").alias("class_id"))
        n = self.class_links()
        counted = n.select(F.col("class_a").alias("class_id")).unionByName(n.select(F.col("class_b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
        out = self.members.join(ids, "class_key").join(counted, "class_id", "left")
        return out.select("record_id", "class_id", "side", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def class_links(self) -> DataFrame:
        """class_a, class_b (least record_id of either text, class_a < class_b), distance, covered: pairs between classes that meet across splits."""
        ids = self.members.groupBy("class_key").agg(F.min("record_id").alias("class_id"))
        a = ids.select(F.col("class_key").alias("x"), F.col("class_id").alias("a"))
        b = ids.select(F.col("class_key").alias("y"), F.col("class_id").alias("b"))
        return self.links.join(a, "x").join(b, "y").select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "distance", "covered")


def overlap_report(records: DataFrame) -> DataFrame:
    """dataset, split, source, n_rows, n_equal, n_overlapping of val and test rows: equal as shipped to a train text
    of the dataset, and equal or nearly so after reduction."""
    rows = records.where("split in ('val', 'test') and record_id is not null")
    pairs = CrossSplitOverlap(records).pairs()
    ids = pairs.select(F.col("record_a").alias("record_id")).unionByName(pairs.select(F.col("record_b").alias("record_id"))).distinct()
    train = records.where("split = 'train' and text is not null").select(F.coalesce("dataset", F.lit("")).alias("ds"), F.xxhash64("text").alias("h")).distinct()
    base = rows.select("record_id", "dataset", "split", "source", F.coalesce("dataset", F.lit("")).alias("ds"), F.xxhash64("text").alias("h"), F.col("text").isNotNull().alias("has"))
    full = base.join(train.withColumn("equal", F.lit(True)), ["ds", "h"], "left").join(ids.withColumn("near", F.lit(True)), "record_id", "left")
    return full.groupBy("dataset", "split", "source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("equal") & F.col("has")).alias("n_equal"),
        F.count_if((F.col("equal") & F.col("has")) | F.col("near")).alias("n_overlapping"),
    )
