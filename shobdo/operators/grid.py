"""The n-gram classifier over a noise grid: every test text noised whole in every cell and classified, over batches of letters.

The noised letters are those of noise.perturb (rates.Units has its eligible units and draws; changes are splices of one
array of letters), the predictions those of models.predictor, n-grams being known by 64 bits of their letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from . import rates
from .noise import N3_POOLS, spread
from .rates import CONS, DROP, HASANTA, NUKTA, VOWEL, WS, _ranges

LETTERS = 1 << 19
_NONE = -(2**31)  # no label
_STOP = rates._STOP


class _Strings:
    """Some strings as one array of letters."""

    def __init__(self, items: list[str]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(items).encode("utf-32-le"), "<u4")

    def of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[_ranges(self.at[k], self.size[k])[0]], self.size[k]


class _Pools(_Strings):
    """Letters exchanged within pools: number of a letter (or of its first letter, alone or with a nukta), first number and size of its pool."""

    def __init__(self, pools: list[list[str]]):
        flat = [x for p in pools for x in p]
        super().__init__(flat)
        self.low = np.repeat(np.cumsum([0] + [len(p) for p in pools[:-1]]), [len(p) for p in pools])
        self.n = np.repeat([len(p) for p in pools], [len(p) for p in pools])
        self.alone, self.marked = np.full(_STOP + 1, -1, np.int32), np.full(_STOP + 1, -1, np.int32)
        for k, x in enumerate(flat):
            (self.alone if len(x) == 1 else self.marked)[ord(x[0])] = k

    def other(self, k: np.ndarray, draw: np.ndarray) -> np.ndarray:
        j = self.low[k] + np.floor(draw * (self.n[k] - 1)).astype(np.int64)
        return j + (j >= k)


@lru_cache(1)
def _tables() -> dict:
    lower, white, vowel_of = np.arange(_STOP + 1, dtype=np.uint32), np.zeros(_STOP + 1, bool), np.zeros(_STOP + 1, np.uint32)
    for i in range(_STOP):
        if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    white[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    for a, b in maps.MATRA_VOWEL.items():
        vowel_of[ord(a)] = ord(b)
    alter = np.zeros(_STOP + 1, np.uint32)
    for a, b in maps.ALTER.items():
        alter[ord(a)] = ord(b)
    return {"lower": lower, "white": white, "vowel_of": vowel_of, "alter": alter, "substitute": _Pools(N3_POOLS), "homophone": _Pools(maps.HOMOPHONES), "insert": _Strings(maps.INSERTABLE)}


@lru_cache(8)
def _tails(tag: str, n: int) -> dict[int, np.ndarray]:
    return rates._tails([b"%s%d" % (tag.encode(), i) for i in range(n)])


class Noised(rates.Units):
    """The letters of some NFC texts under noise, with a mark before each text and one at the end."""

    def __init__(self, texts: list[str], combining: str):
        super().__init__(texts, combining)
        self.f = rates._classes(combining)[self.code]
        self._kept: dict = {}

    def places(self, noise_type: str) -> tuple[np.ndarray, ...]:
        """Of the eligible units, in order: first letter, letter behind the last, index in the text, text."""
        if noise_type not in self._kept:
            self._kept[noise_type] = self._places(noise_type)
        return self._kept[noise_type]

    def _places(self, noise_type: str):
        f, n = self.f, len(self.f)
        inner = self.code != _STOP
        before, text = np.roll(f, 1), np.cumsum(~inner) - 1
        bounds = np.append(self.unit, n)
        if noise_type == "matra_perturb":
            x = np.flatnonzero((f & DROP) > 0)
            return x, x + 1, x - self.at[text[x]] - 1, text[x]
        if noise_type == "homophone_confuse":
            nukta = (f & NUKTA) > 0
            last = np.maximum.accumulate(np.where(nukta, 0, np.arange(n)))
            consumed = nukta & ((np.arange(n) - last + ~inner[last]) % 2 == 1)
            index = np.cumsum(inner & ~consumed)
            behind = np.append(nukta[1:], False)
            pools = _tables()["homophone"]
            x = np.flatnonzero(np.where(behind, pools.marked[self.code], pools.alone[self.code]) >= 0)
            return x, x + 1 + behind[x], index[x] - index[self.at[text[x]]] - 1, text[x]
        if noise_type == "whitespace_error":
            ws, new = (f & WS) > 0, np.zeros(n, bool)
            new[self.unit] = True
            edge = (before & (rates.END | WS)) > 0
            begins = inner & np.where(ws, (before & WS) == 0, new | edge)
            x = np.flatnonzero(begins | ~inner)
            index, y = np.cumsum(begins), np.append(x[1:], n)
            behind = np.append(x[1:], n - 1)
            split = begins[x] & ~ws[x] & begins[behind] & ~ws[behind]
            merge = begins[x] & ws[x] & inner[x - 1] & inner[behind]
            e = split | merge
            return x[e], y[e], index[x[e]] - index[self.at[text[x[e]]]] - 1, text[x[e]]
        if noise_type in ("char_insert", "char_transpose"):
            u = np.flatnonzero(self.pair)
        elif noise_type == "char_delete":
            u = np.flatnonzero(self.taken_whole)
        elif noise_type == "char_substitute":
            u = np.flatnonzero((f[self.unit] & rates.SUBST) > 0)
        elif noise_type == "conjunct_split":
            h = np.flatnonzero(((f & HASANTA) > 0) & ((before & CONS) > 0) & ((np.roll(f, -1) & CONS) > 0))
            signs = np.cumsum((f & HASANTA) > 0)
            of = self.number[h]
            h = h[signs[bounds[of + 1] - 1] - signs[bounds[of] - 1] == 1]
            u = self.number[h]
            return h, h + 1, u - self.first[self.row[u]] - 1, self.row[u]
        else:
            u = np.unique(self.number[np.flatnonzero((f & VOWEL) > 0)])
        return self.unit[u], bounds[u + 1], u - self.first[self.row[u]] - 1, self.row[u]

    def noised(self, noise_type: str, severity: int, seed: int) -> np.ndarray:
        asked, rows, states = self.requested(noise_type, severity, seed, True)
        some = np.flatnonzero(asked[rows] > 0)
        if not len(some):
            return self.code
        own, tables = rows[some], _tables()
        x, y, index, _ = self.places(noise_type)
        n = self.eligible[noise_type]
        lane, cell = _ranges((np.cumsum(n) - n)[own], n[own])
        size = 1 << int(max(1, np.max(np.diff(np.append(self.at, len(self.code)))))).bit_length()
        h = rates._hashes(states, some[cell], _tails("p", size), index[lane])
        removed, put = np.zeros(len(self.code), bool), None
        if noise_type == "char_transpose":
            u = np.flatnonzero(self.pair)[lane]
            picked = np.flatnonzero(rates.picked_pairs(u, cell, h))
            order = picked[np.lexsort((h[picked], cell[picked]))]
            rank = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
            u = np.sort(u[order[rank < asked[own][cell[order]]]])
            bounds = np.append(self.unit, len(self.code))
            a, b, e = bounds[u], bounds[u + 1], bounds[u + 2]
            moved = _ranges(a, b - a)[0]
            removed[moved] = True
            return _composed(_spliced(self.code, removed, e, self.code[moved], b - a))
        gone = rates.taken(cell, h, n[own], asked[own])
        if noise_type == "char_delete":
            u = np.flatnonzero(self.taken_whole)[lane]
            begin = np.flatnonzero(np.append(True, (np.diff(u) != 1) | (np.diff(cell) != 0)))
            full, most = np.logical_and.reduceat(gone, begin), np.maximum.reduceat(h, begin)
            token = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(u))))
            gone &= ~(full[token] & (h == most[token]))
        lane, key = lane[gone], some[cell[gone]]
        x, y, index = x[lane], y[lane], index[lane]

        def draw(tag: str) -> np.ndarray:
            return (rates._hashes(states, key, _tails(tag, size), index) >> np.uint64(12)) / 4503599627370496.0

        if noise_type in ("char_delete", "conjunct_split"):
            removed[_ranges(x, y - x)[0]] = True
        elif noise_type == "char_insert":
            put = (y, *tables["insert"].of(np.floor(draw("c") * len(maps.INSERTABLE)).astype(np.int64)))
        elif noise_type in ("char_substitute", "homophone_confuse"):
            pools = tables["substitute" if noise_type == "char_substitute" else "homophone"]
            marked = ((self.f[x + 1] & NUKTA) > 0) & (pools.marked[self.code[x]] >= 0)
            k = np.where(marked, pools.marked[self.code[x]], pools.alone[self.code[x]])
            removed[x] = True
            removed[x[marked] + 1] = True
            put = (x, *pools.of(pools.other(k, draw("c"))))
        elif noise_type == "matra_perturb":
            to = tables["alter"][self.code[x]]
            altered = (to > 0) & (draw("c") < 0.5)
            removed[x] = True
            put = (x[altered], to[altered], np.ones(int(altered.sum()), np.int64))
        elif noise_type == "elongate":
            unit = self.number[x]
            v = np.flatnonzero((self.f & VOWEL) > 0)
            last = v[np.searchsorted(self.number[v], unit, "right") - 1]
            m = np.flatnonzero(tables["vowel_of"][self.code] > 0)
            m = np.append(m, len(self.code) - 1)
            first = m[np.searchsorted(self.number[m], unit)]
            has = (self.number[first] == unit) & (self.code[first] != _STOP)
            vowels = {ord(c) for c in maps.VOWELS}
            alone = (y - x == 1) & np.isin(self.code[x], np.array(sorted(vowels), np.uint32))
            vowel = has & (np.floor(draw("c") * (has.astype(int) + alone + 1)) == 0)
            times = np.where(vowel, 1, 1 + np.floor(draw("r") * 3).astype(np.int64))
            letter = np.where(vowel, tables["vowel_of"][self.code[first]], self.code[last])
            put = (np.where(vowel, first, last) + 1, np.repeat(letter, times).astype(np.uint32), times)
        else:
            solid = (self.f[x] & WS) == 0
            removed[_ranges(x[~solid], (y - x)[~solid])[0]] = True
            put = (y[solid], np.full(int(solid.sum()), 32, np.uint32), np.ones(int(solid.sum()), np.int64))
        return _composed(_spliced(self.code, removed, *(put or (x[:0], self.code[:0], x[:0]))))


def _spliced(code: np.ndarray, removed: np.ndarray, at: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letters without the removed ones, and with sizes[k] others put before each place, places rising."""
    extra = np.zeros(len(code), np.int64)
    extra[at] = sizes
    kept = ~removed
    to = np.cumsum(extra + kept)
    out = np.empty(int(to[-1]), np.uint32)
    out[to[kept] - 1] = code[kept]
    out[_ranges(to[at] - kept[at] - sizes, sizes)[0]] = letters
    return out


def _composed(code: np.ndarray) -> np.ndarray:
    """NFC after an edit of NFC text: only the two composed vowel signs can arise."""
    p = np.flatnonzero((code[:-1] == 0x9C7) & ((code[1:] == 0x9BE) | (code[1:] == 0x9D7)))
    if not len(p):
        return code
    out = code.copy()
    out[p] = np.where(code[p + 1] == 0x9BE, 0x9CB, 0x9CC)
    return np.delete(out, p + 1)


_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xBF58476D1CE4E5B9)


def _number(h: np.ndarray, n: int) -> np.ndarray:
    return (h + np.uint64(n * int(_B) % 2**64)) * _M


class Scorer:
    """The fitted classifier as arrays: n-grams in an open table by the first bits of their numbers."""

    def __init__(self, model: Model):
        features, classes = model.stages
        self.idf = np.asarray(features.stages[1].getScalingVec().toArray())
        self.weights = [m.coefficients.toArray() for m in classes.models]
        self.intercepts = [m.intercept for m in classes.models]
        words = features.stages[0].vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        at, self.grams = np.cumsum(sizes) - sizes, np.zeros(len(words), np.uint64)
        for n in range(2, 6):
            k = np.flatnonzero(sizes == n)
            h = letters[at[k]]
            for i in range(1, n):
                h = h * _A + letters[at[k] + i]
            self.grams[k] = _number(h, n)
        self.shift = np.uint64(64 - max(8, (4 * len(words)).bit_length()))
        self.table = np.full((1 << int(64 - self.shift)) + 1, -1, np.int32)
        todo, slot = np.arange(len(words)), (self.grams >> self.shift).astype(np.int64)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]  # of several the last stays
            left = self.table[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) % len(self.table)

    def found(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the features, -1 for others."""
        slot = (grams >> self.shift).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.grams[out] != grams)) if len(self.grams) else out[:0]
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) % len(self.table)
            out[open_] = k = self.table[slot]
            more = (k >= 0) & (self.grams[k] != grams[open_])
            open_, slot = open_[more], slot[more]
        return out

    def predictions(self, code: np.ndarray, n_texts: int) -> np.ndarray:
        """Classes of texts given as letters with marks."""
        tables = _tables()
        if np.any((code == 0x130) | (code == 0x3A3)):  # lower case of these depends on more than the letter
            text = np.split(code, np.flatnonzero(code == _STOP))[1:-1]
            code = np.concatenate([y for x in text for y in ([np.uint32(_STOP)], np.frombuffer(x[1:].astype("<u4").tobytes().decode("utf-32-le").lower().encode("utf-32-le"), "<u4"))] + [[np.uint32(_STOP)]]).astype(np.uint32)
        else:
            code = tables["lower"][code]
        blank = tables["white"][code] | (code == _STOP)
        row = (np.cumsum(code == _STOP, dtype=np.int64) - 1)
        keep = ~blank | np.append(~blank[1:], True)  # of blanks in a row, and the marks among them, the last
        blank, row = blank[keep], row[keep]
        c = np.where(blank, 32, code[keep]).astype(np.uint64)
        h, whole, keys = c, np.ones(len(c), bool), []
        for n in range(2, 6):
            if len(c) < n:
                break
            h = h[:-1] * _A + c[n - 1 :]
            whole = whole[:-1] & ~blank[n - 2 : len(c) - 1] if n > 2 else whole[:-1]
            p = np.flatnonzero(whole)
            k = self.found(_number(h[p], n))
            known = k >= 0
            keys.append((row[p[known]] << 32) | k[known])
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        tf = np.diff(np.append(first, len(key)))
        r, k = key[first] >> 32, key[first] & 0xFFFFFFFF
        x = tf * self.idf[k]
        norm = np.sqrt(np.bincount(r, x * x, n_texts))
        norm[norm == 0] = 1
        return np.argmax([np.bincount(r, x * w[k], n_texts) / norm + b for w, b in zip(self.weights, self.intercepts, strict=True)], 0)


def grid_confusion(test: DataFrame, model: Model, severities: list[int], seed: int, types: list[str] = maps.NOISE_TYPES) -> DataFrame:
    """Counts n of y_true and y_pred for every type and severity, and for the clean text ('' at 0): some rows a cell."""
    spark = test.sparkSession
    combining, scorer = rates.marks(spark), spark.sparkContext.broadcast(Scorer(model))
    cells = [("", 0), *((x, s) for x in types for s in severities)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}

        def add(rows: list[tuple[str | None, int | None]]) -> None:
            # texts without value are not noised; they count as clean and as noised texts without n-grams
            raw = [x or "" for x, _ in rows]
            true = np.array([_NONE if y is None else y for _, y in rows])
            nfc = [unicodedata.normalize("NFC", x) for x in raw]
            texts = Noised(nfc, combining)
            clean = texts if nfc == raw else None
            for x, s in cells:
                code = texts.noised(x, s, seed) if x else clean.code if clean else rates.Units(raw, combining).code
                pairs, n = np.unique(np.stack([true, scorer.value.predictions(code, len(rows))]), axis=1, return_counts=True)
                for (a, b), k in zip(pairs.T.tolist(), n.tolist(), strict=True):
                    total[x, s, a, b] = total.get((x, s, a, b), 0) + k

        held, letters = [], 0
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((x, y))
                letters += len(x or "")
                if letters >= LETTERS or len(held) >= 1 << 16:
                    add(held)
                    held, letters = [], 0
        if held:
            add(held)
        columns = list(zip(*(k for k in total), strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)), pa.array(list(total.values()), pa.int64())], ["noise_type", "severity", "y_true", "y_pred", "n"])

    rows = spread(test.select("text", F.col("label").cast("int").alias("label")))
    out = rows.mapInArrow(counted, "noise_type string, severity int, y_true int, y_pred int, n long")
    return out.withColumn("y_true", F.nullif("y_true", F.lit(_NONE)))
