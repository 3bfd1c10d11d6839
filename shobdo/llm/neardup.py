"""Near-duplicate documents by the similarity of their word n-grams (problem 5).

Prefix filtering: the n-grams of a document are put in one global order, the rarest first; two documents of
similarity t or more share an n-gram among the first n - ceil(t n) + 1 of both.  N-grams that only one document has come
first in that order and can be in no other prefix, so only repeated ones are ever sent back to their documents.

1. A task hashes the n-grams of a block of texts and sends them, packed, to buckets by hash: ten bytes an n-gram, the
   only shuffle of all n-grams.  Of equal sets in a block one is sent; an n-gram that at least `HOT` documents
   of the block have is not sent per document but as a marker, and counts as most frequent everywhere.
2. A bucket counts its n-grams and returns the repeated ones with their documents.
3. Documents of equal n-gram sets are one class with one representative.  Representatives' prefixes are joined on
   the n-gram under the length and the positional filter.
4. Every candidate pair is verified once: suffix filter, then the exact overlap, which needs the repeated n-grams only.

Defined results: null texts and texts of fewer words than n have no n-grams and never count; equal documents pair with
similarity 1; similarity counts distinct n-grams; any length; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, cut, text_blocks, written
from .consistent import Words, mix

#: An n-gram of so many distinct texts of a block is sent as a marker instead of per text
HOT = 16
MOST_FREQUENT = (1 << 31) - 1
_NUDGE = 1e-9  # ceil() of products such as 0.8 * 5

_MESSAGE = "bucket int, kind int, grams binary, places binary, ref bigint, doc_id bigint, n int, class_key bigint"
_MESSAGE_ARROW = pa.schema(
    [
        ("bucket", pa.int32()), ("kind", pa.int32()), ("grams", pa.binary()), ("places", pa.binary()),
        ("ref", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("class_key", pa.int64()),
    ]
)
_REPEATED = "ref bigint, gram bigint, df int, doc_id bigint, n int, class_key bigint"
_REPEATED_ARROW = pa.schema(
    [("ref", pa.int64()), ("gram", pa.int64()), ("df", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("class_key", pa.int64())]
)


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (64 bits each) of all texts, by text and then by value, and the number of each text."""
    w = Words(texts)
    h, doc = w.hash, w.doc
    m = max(0, len(h) - n + 1)
    gram = np.zeros(m, np.uint64)
    for k in range(n):
        gram = mix(gram * np.uint64(0x9FB21C651E98DF25) + h[k : m + k] + np.uint64(k + 1))
    own = doc[:m] == doc[n - 1 : m + n - 1] if m else np.zeros(0, bool)
    gram, doc = gram[own], doc[:m][own]
    by = np.lexsort((gram, doc))
    gram, doc = gram[by], doc[by]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[new], doc[new]


def _messages(texts: list[str | None], keys: list[int], base: int, n: int, n_buckets: int) -> pa.RecordBatch:
    gram, doc = gram_sets(texts, n)
    size = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(size) - size
    has = np.flatnonzero(size)
    # the class of a text: a hash of its set, a sum being free of order
    key = mix(np.add.reduceat(mix(gram ^ np.uint64(0xA5A5A5A5DEADBEEF)), start[has]) + size[has].astype(np.uint64)) if len(has) else np.zeros(0, np.uint64)
    _, first = np.unique(key, return_index=True)
    sends = np.zeros(len(texts), bool)
    sends[has[first]] = True
    rows: list[tuple] = []
    for d, k in zip(has.tolist(), key.view(np.int64).tolist(), strict=True):
        rows.append((int(k % n_buckets), 1, None, None, base + d if sends[d] else -1, keys[d], int(size[d]), k))
    keep = sends[doc]
    gram, doc = gram[keep], doc[keep]
    by = np.argsort(gram, kind="stable")
    gram, doc = gram[by], doc[by]
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(gram)))
    hot = np.repeat(count >= HOT, count)
    by = np.argsort(doc[hot], kind="stable")
    hot_doc, hot_gram = doc[hot][by], gram[hot][by]
    cuts = np.append(np.flatnonzero(np.append(True, hot_doc[1:] != hot_doc[:-1])), len(hot_doc)) if len(hot_doc) else np.zeros(1, np.int64)
    for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        d = int(hot_doc[i])
        rows.append((d % n_buckets, 2, hot_gram[i:j].tobytes(), None, base + d, None, None, None))
    marks = gram[begin[count >= HOT]]
    mark_bucket = (marks % np.uint64(n_buckets)).astype(np.int64)
    for b in np.unique(mark_bucket).tolist():
        rows.append((b, 3, marks[mark_bucket == b].tobytes(), None, None, None, None, None))
    gram, doc = gram[~hot], doc[~hot]
    bucket = (gram % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    # the buckets that the block has something for, however many there are
    present, cuts = np.unique(bucket[by], return_index=True)
    gram, place = gram[by], doc[by].astype(np.uint16)
    for b, i, j in zip(present.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(gram)], strict=True):
        rows.append((b, 0, gram[i:j].tobytes(), place[i:j].tobytes(), base, None, None, None))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE_ARROW, strict=True)], schema=_MESSAGE_ARROW)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Repeated n-grams of one bucket with their documents, next to what only passes through."""
    kind = table["kind"].to_numpy()
    out = []

    def rows(**cols):
        size = len(next(iter(cols.values())))
        arrays = [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in _REPEATED_ARROW]
        out.append(pa.table(arrays, schema=_REPEATED_ARROW))

    members = table.filter(pa.array(kind == 1))
    if members.num_rows:
        rows(**{c: members[c].combine_chunks() for c in ("ref", "doc_id", "n", "class_key")})
    for m in table.filter(pa.array(kind == 2)).to_pylist():
        g = np.frombuffer(m["grams"], np.int64)
        rows(ref=np.full(len(g), m["ref"]), gram=g, df=np.full(len(g), MOST_FREQUENT, np.int32))
    marks = [np.frombuffer(g, np.uint64) for g in table.filter(pa.array(kind == 3))["grams"].to_pylist()]
    hot = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
    sent = table.filter(pa.array(kind == 0))
    if sent.num_rows:
        gram = np.concatenate([np.frombuffer(g, np.uint64) for g in sent["grams"].to_pylist()])
        ref = np.concatenate([np.frombuffer(p, np.uint16).astype(np.int64) + b for p, b in zip(sent["places"].to_pylist(), sent["ref"].to_pylist(), strict=True)])
        by = np.argsort(gram)
        gram = gram[by]
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        count = np.diff(np.append(begin, len(gram)))
        df = np.where(np.isin(gram[begin], hot), MOST_FREQUENT, count).astype(np.int32)
        df = np.repeat(df, count)
        keep = df > 1
        rows(ref=ref[by[keep]], gram=gram[keep].view(np.int64), df=df[keep])
    return pa.concat_tables(out) if out else _REPEATED_ARROW.empty_table()


def repeated_grams(docs: DataFrame, n: int) -> DataFrame:
    """Written table: rows with gram set are repeated n-grams of the text `ref`; the others are the documents."""
    n_buckets = bucket_count(docs)[1]

    def send(batches):
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                for i in range(a, b, 1 << 16):  # places have 16 bits
                    j = min(b, i + (1 << 16))
                    yield _messages(texts[i:j], keys[i:j], base, n, n_buckets)
                    base += 1 << 16

    sent = docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInArrow(send, _MESSAGE)
    return written(sent.groupBy("bucket").applyInArrow(_count_bucket, _REPEATED), "grams")


def _overlap_needed(a: str, b: str, t: float):
    return F.ceil(F.lit(t / (1 + t)) * (F.col(a) + F.col(b)) - _NUDGE)


def suffix_filter(a: np.ndarray, b: np.ndarray, most: int, depth: int = 2) -> bool:
    """False if two ordered sets surely differ by more than `most` items: halves around a probe of b are compared."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b)) <= most
    mid = len(b) // 2
    at = int(np.searchsorted(a, b[mid]))
    same = at < len(a) and a[at] == b[mid]
    left, right = abs(at - mid), abs((len(a) - at - same) - (len(b) - mid - 1))
    if left + right + (not same) > most:
        return False
    return suffix_filter(a[:at], b[:mid], most - right - (not same), depth - 1) and suffix_filter(
        a[at + same :], b[mid + 1 :], most - left - (not same), depth - 1
    )


def _verify(t: float):
    def run(batches):
        for batch in batches:
            d = batch.to_pydict()
            keep, sims = [], []
            for i in range(batch.num_rows):
                na, nb = d["na"][i], d["nb"][i]
                a, b = np.array(d["ga"][i], np.int64), np.array(d["gb"][i], np.int64)  # repeated n-grams by value
                need = math.ceil(t / (1 + t) * (na + nb) - _NUDGE)
                # items that either lacks: the unrepeated ones are never common
                if not suffix_filter(a, b, len(a) + len(b) - 2 * need):
                    continue
                both = np.searchsorted(a, b)
                common = int((a[np.minimum(both, len(a) - 1)] == b).sum())
                sim = common / (na + nb - common)
                if common >= need and sim >= t - _NUDGE:
                    keep.append(i)
                    sims.append(sim)
            yield pa.RecordBatch.from_pydict({"doc_a": [d["a"][i] for i in keep], "doc_b": [d["b"][i] for i in keep], "similarity": pa.array(sims, pa.float64())},
                schema=pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("similarity", pa.float64())]))

    return run


class NearDuplicates:
    """members: doc_id, class_id, n (written).  links: pairs of class ids with their similarity (checkpointed)."""

    def __init__(self, docs: DataFrame, n: int = 5, threshold: float = 0.8):
        t = threshold
        found = repeated_grams(docs, n)
        member = found.where("gram is null").select("doc_id", "class_key", "n", "ref")
        # of the texts whose n-grams were sent, the one with the least id stands for its class
        rep = member.where("ref >= 0").groupBy("class_key").agg(F.min_by(F.struct("doc_id", "ref", "n"), F.struct("doc_id", "ref")).alias("r"))
        rep = rep.select("class_key", F.col("r.doc_id").alias("class_id"), "r.ref", F.col("r.n").alias("n"))
        self.members = member.join(rep.select("class_key", "class_id"), "class_key").select("doc_id", "class_id", "n")
        lists = found.where("gram is not null").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
        sets = cut(
            lists.join(rep, "ref").select(
                F.col("class_id").alias("id"), "n", F.col("grams.gram").alias("grams"), (F.col("n") - F.size("grams")).alias("alone")
            )
        )
        length = (F.col("n") - F.ceil(F.lit(t) * F.col("n") - _NUDGE) + 1 - F.col("alone")).cast("int")
        prefix = sets.where(length > 0).select("id", "n", F.posexplode(F.slice("grams", F.lit(1), length)).alias("k", "gram"), "alone")
        prefix = prefix.select("id", "n", "gram", (F.col("alone") + F.col("k")).alias("pos"))
        a = prefix.select("gram", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        b = prefix.select("gram", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        close = (F.least("na", "nb") + _NUDGE >= F.lit(t) * F.greatest("na", "nb")) & (
            F.least("pa", "pb") + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= _overlap_needed("na", "nb", t)
        )
        candidates = a.join(b, "gram").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
        by_value = sets.select("id", "n", F.array_sort("grams").alias("g"))
        full = candidates.join(by_value.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga")), "a").join(
            by_value.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb")), "b"
        )
        self.links = full.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_verify(t), "doc_a bigint, doc_b bigint, similarity double")

    def pairs(self) -> DataFrame:
        """doc_a < doc_b, similarity: every pair of documents, members of classes written out."""
        m = self.members
        same = m.alias("x").join(m.alias("y"), "class_id").where("x.doc_id < y.doc_id")
        same = same.select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"), F.lit(1.0).alias("similarity"))
        x = m.select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("x"))
        y = m.select(F.col("class_id").alias("doc_b"), F.col("doc_id").alias("y"))
        cross = self.links.join(x, "doc_a").join(y, "doc_b")
        cross = cross.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "similarity")
        return same.unionByName(cross)

    def classes(self) -> DataFrame:
        """doc_id, class_id, copies, n_links: one row a document; links are to classes of other texts."""
        links = cut(self.links)
        ends = links.select(F.col("doc_a").alias("class_id")).unionByName(links.select(F.col("doc_b").alias("class_id")))
        counted = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
        copies = self.members.groupBy("class_id").agg(F.count("*").alias("copies"))
        out = self.members.join(copies, "class_id").join(counted, "class_id", "left")
        return out.select("doc_id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
