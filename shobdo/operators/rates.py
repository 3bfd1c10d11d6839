"""How many units each noise type takes, without the noised texts: what perturb counts, over whole batches of letters.

Classes of letters, clusters and eligible units come from arrays over all letters of a batch.  Each cell of type, severity
and seed costs one sha256 of the text; hashes of units are made only where a count depends on them: for tokens that a
deletion may take whole, and for transpositions that may run out of pairs or exchange equal clusters.  The md5 of a unit
is one block beyond its key's, so many are made at once.  Order among units is by 64 bits of the md5 (perturb: 128).

Every other type applies what is requested, and changes the text if it applies anything: no rewriting of one unit gives
the letters it had, and insertions, splits and deletions move the letters behind them.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from .noise import _check_type, fraction, spread

#: Letters handled at once, and md5 blocks at once
LETTERS, LANES = 1 << 20, 1 << 14
MARK, E, C, LINE, WS, SUBST, HOMO, HOMO_NUKTA, DROP, HASANTA, CONS, VOWEL, NUKTA, END = (1 << k for k in range(14))
_STOP = 0x110000  # stands before each text and behind the last
_ALL = "".join(chr(i) for i in range(_STOP) if not 0xD800 <= i < 0xE000)
SUMS = ["n_texts", "eligible", "requested", "applied", "n_asking", "ratios", "nominal", "changed"]


def marks(spark) -> str:
    """The letters of the class M as the JVM has it, which the patterns of perturb use."""
    return spark._jvm.java.util.regex.Pattern.compile(r"\P{M}+").matcher(_ALL).replaceAll("")


@lru_cache(2)
def _classes(combining: str) -> np.ndarray:
    table = np.zeros(_STOP + 1, np.uint16)

    def add(bit: int, chars) -> None:
        table[[ord(c) for c in chars]] |= bit

    def listed(inside: str) -> list[str]:
        return re.findall("[" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), inside) + "]", _ALL)

    single = lambda items: [x for x in items if len(x) == 1]
    members = [m for s in maps.HOMOPHONES for m in s]
    add(MARK, combining + "\u200c\u200d")
    add(E, listed(maps._E))
    add(C, listed(maps._C))
    add(LINE, "\r\n")
    add(WS, listed(maps.WS))
    add(SUBST, single(maps.CONSONANTS + maps.VOWELS + maps.DIGITS) + [x[0] for x in maps.NUKTA_LETTERS])
    add(HOMO, single(members))
    add(HOMO_NUKTA, [m[0] for m in members if len(m) > 1])
    add(DROP, maps.DROP_TARGETS)
    add(HASANTA, maps.HASANTA)
    add(CONS, listed(maps.CONSONANT_POINT[1:-1]))
    add(VOWEL, maps.MATRAS + maps.VOWELS)
    add(NUKTA, maps.NUKTA)
    table[_STOP] = END
    return table


_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_INIT = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _rounds(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, words: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The rounds of md5 on each lane, in place and without the last addition; words that are not given are 0."""
    t = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        a += t
        a += _K[i]
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if g in words:
            a += words[g]
        r = _SHIFTS[i // 16][i % 4]
        np.left_shift(a, np.uint32(r), out=t)
        a >>= np.uint32(32 - r)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return a, b, c, d


_HEX = np.array([f"{i:02x}".encode() for i in range(256)]).view(np.uint16)


def _keys(prefix: str, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    """md5 states behind the keys of some texts, a key being 64 hex digits, which are one block: 4 x rows."""
    head, sha = prefix.encode(), hashlib.sha256
    digests = np.frombuffer(b"".join([sha(head + texts[r]).digest() for r in rows.tolist()]), np.uint8).reshape(-1, 32)
    out = np.empty((4, len(rows)), np.uint32)
    for k in range(0, len(rows), LANES):
        words = _HEX[digests[k : k + LANES]].view("<u4").T.copy()
        n = words.shape[1]
        for x, y, z in zip(out, _INIT, _rounds(*(np.full(n, x) for x in _INIT), dict(enumerate(words))), strict=True):
            np.add(z, y, out=x[k : k + n])
    return out


def _tails(tails: list[bytes]) -> dict[int, np.ndarray]:
    """Words of the last blocks of a key and a tail each, by their number; those that are always 0 are left out."""
    block = np.array([(x + b"\x80").ljust(12, b"\0") + ((64 + len(x)) * 8).to_bytes(4, "little") for x in tails], "S16")
    return {k: x.copy() for k, x in zip((0, 1, 2, 14), np.frombuffer(block.tobytes(), "<u4").reshape(-1, 4).T, strict=True) if x.any()}


_ROUND = _tails([b"k"])


@lru_cache(4)
def _places(n: int) -> dict[int, np.ndarray]:
    return _tails([b"p%d" % i for i in range(n)])


def _hashes(states: np.ndarray, key: np.ndarray, tails: dict[int, np.ndarray], tail: np.ndarray) -> np.ndarray:
    """The first 64 bits of md5(key, tail), by numbers of keys and of tails."""
    out = np.empty(len(key), np.uint64)
    for k in range(0, len(key), LANES):
        own, last = key[k : k + LANES], tail[k : k + LANES]
        state = [x.take(own) for x in states]
        a, b, _, _ = _rounds(state[0].copy(), state[1].copy(), *state[2:], {i: w.take(last) for i, w in tails.items()})
        a += state[0]
        b += state[1]
        # the digits begin with the least byte of a; in memory b stands below a, as in a number of 64 bits
        np.stack([b.byteswap(True), a.byteswap(True)], 1, out=out[k : k + LANES].view(np.uint32).reshape(-1, 2))
    return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... n[k] of them for each k; and the k of each."""
    k = np.repeat(np.arange(len(n)), n)
    return np.arange(len(k)) + (first - np.cumsum(n) + n)[k], k


_TOP = np.uint64(2**64 - 1)


def taken(cell: np.ndarray, h: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether a hash is among the least of its cell: k of n; at most 65,536 cells, each with one or more to take."""
    ends = np.cumsum(n)
    at = ends - n + k  # behind the last that is taken
    packed = (cell.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    ordered = np.sort(packed)
    if np.any(ordered[at - 1][at < ends] == ordered[at[at < ends]]):  # 48 bits do not tell them apart
        out = np.empty(len(h), bool)
        out[np.lexsort((h, cell))] = np.arange(len(h)) < np.repeat(at, n)
        return out
    return packed <= ordered[at - 1][cell]


def picked_pairs(u: np.ndarray, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pairs (u, u + 1) are picked, in the order of their hashes, unless a neighbour was."""
    follows = np.append(False, (np.diff(u) == 1) & (np.diff(cell) == 0))  # the pair before is a neighbour
    picked, open_, at = np.zeros(len(u), bool), np.ones(len(u), bool), np.arange(len(u))
    while len(at):
        # all pairs before both of their open neighbours are picked, as in the order of hashes they would be
        left = np.where(follows[at] & open_[at - 1], h[at - 1], _TOP)
        after = np.minimum(at + 1, len(u) - 1)
        right = np.where((at + 1 < len(u)) & follows[after] & open_[after], h[after], _TOP)
        won = at[(h[at] < left) & (h[at] <= right) | ((left == _TOP) & (right == _TOP))]
        picked[won] = True
        open_[won] = False
        open_[won[follows[won]] - 1] = False
        after = won[won + 1 < len(u)] + 1
        open_[after[follows[after]]] = False
        at = at[open_[at]]
    return picked


class Units:
    """Clusters and eligible units of some NFC texts."""

    def __init__(self, texts: list[str], combining: str):
        self.n, self.bytes = len(texts), [x.encode() for x in texts]
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.at = np.cumsum(sizes + 1) - sizes - 1  # of the mark before each text
        code = np.full(int(sizes.sum()) + self.n + 1, _STOP, np.uint32)
        inner = np.ones(len(code), bool)
        inner[self.at] = inner[-1] = False
        code[inner] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        f = _classes(combining)[code]
        self.code, end, ws = code, ~inner, (f & WS) > 0
        before = np.roll(f, 1)
        attached = ((f & MARK) > 0) & ((before & (LINE | END)) == 0)
        new = ~attached & inner
        new &= ~((code == 10) & (np.roll(code, 1) == 13))
        # a consonant behind a consonant and signs with a hasanta among them is of its cluster
        hasanta = np.cumsum((f & HASANTA) > 0, dtype=np.int32)
        last = np.maximum.accumulate(np.where((f & E) > 0, 0, np.arange(len(f))))
        p = np.flatnonzero(((f & C) > 0) & ((before & E) > 0))
        q = last[p - 1]
        new[p[((f[q] & C) > 0) & (hasanta[p - 1] > hasanta[q])]] = False

        begins = new | end
        self.unit = np.flatnonzero(begins)  # with the marks between texts, which are not solid
        self.number = np.cumsum(begins, dtype=np.int32) - 1
        self.first = self.number[self.at]
        self.row = (np.cumsum(end[self.unit], dtype=np.int32) - 1).clip(max=self.n - 1)
        solid = ~end[self.unit] & (~ws[self.unit] | np.append(attached, False)[self.unit + 1])
        self.pair = solid & np.append(solid[1:], False)
        self.taken_whole = self.pair | np.append(False, self.pair[:-1])
        nukta = np.append((f[1:] & NUKTA) > 0, False)
        has = np.flatnonzero(((f & HASANTA) > 0) & ((before & CONS) > 0) & ((np.roll(f, -1) & CONS) > 0))
        of = self.number[has]
        bounds = np.append(self.unit, len(f))
        one = of[hasanta[bounds[of + 1] - 1] - hasanta[bounds[of] - 1] == 1]
        vowels = self.number[np.flatnonzero((f & VOWEL) > 0)]
        split = new & ((before & (WS | END)) == 0) & ~ws
        tokens = inner & ~ws & ((before & (WS | END)) > 0)
        pairs = self._count(self.pair)
        self.eligible = {
            "char_insert": pairs, "char_transpose": pairs, "char_delete": self._count(self.taken_whole), "char_substitute": self._count((f[self.unit] & SUBST) > 0),
            "homophone_confuse": self._letters(np.where(nukta, (f & HOMO_NUKTA) > 0, (f & HOMO) > 0)), "matra_perturb": self._letters((f & DROP) > 0),
            "conjunct_split": np.bincount(self.row[one], minlength=self.n), "elongate": np.bincount(self.row[vowels[np.append(True, vowels[1:] != vowels[:-1])[: len(vowels)]]], minlength=self.n),
            "whitespace_error": self._letters(split) + np.maximum(self._letters(tokens) - 1, 0),
        }

    def _sums(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = np.cumsum(x, dtype=np.int64)
        return np.append(s[at[1:]], s[-1]) - s[at]

    def _count(self, x: np.ndarray) -> np.ndarray:
        """By text, of true units (false for the marks, which are the first units)."""
        return self._sums(x, self.first)

    def _letters(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x, self.at)

    def requested(self, noise_type: str, severity: int, seed: int, keys: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_requested by text; the texts whose key was needed (all with eligible units for keys), and its states."""
        n = self.eligible[noise_type]
        share = n * fraction(severity)
        whole = np.floor(share)
        needed = n > 0
        if not keys and noise_type not in ("char_delete", "char_transpose"):
            needed = needed & (share > whole)
        rows = np.flatnonzero(needed)
        states = _keys(f"{seed}\x1f{noise_type}\x1f{severity}\x1f", self.bytes, rows)
        u = (_hashes(states, np.arange(len(rows)), _ROUND, np.zeros(len(rows), np.int64)) >> np.uint64(12)) / 4503599627370496.0
        whole[rows] += u < (share - whole)[rows]
        return np.minimum(n, whole).astype(np.int64), rows, states

    def deleted(self, requested: np.ndarray, rows: np.ndarray, states: np.ndarray) -> np.ndarray:
        """n_applied: a token all of whose clusters are taken keeps one."""
        applied = requested.copy()
        place = np.flatnonzero(self.taken_whole)
        if not len(place):
            return applied
        new = np.append(True, np.diff(place) > 1)
        begin = np.flatnonzero(new)
        shortest = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(shortest, self.row[place[begin]], np.diff(np.append(begin, len(place))))
        some = np.flatnonzero(requested[rows] >= shortest[rows])
        n = self.eligible["char_delete"]
        offset = np.cumsum(n) - n
        for k in range(0, len(some), 1 << 16):
            key = some[k : k + (1 << 16)]
            own = rows[key]
            lane, cell = _ranges(offset[own], n[own])
            u = place[lane]
            h = _hashes(states, key[cell], _places(1 << int(max(self.lengths())).bit_length()), u - self.first[own][cell] - 1)
            gone = taken(cell, h, n[own], requested[own])
            begin = np.flatnonzero(new[lane])
            full = np.logical_and.reduceat(gone, begin)
            applied[own] -= np.bincount(cell[begin[full]], minlength=len(own))
        return applied

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.unit) - 1))

    def equal_pairs(self) -> np.ndarray:
        """Pairs of neighbouring clusters whose exchange changes nothing."""
        out = np.zeros(len(self.unit), bool)
        u = np.flatnonzero(self.pair)
        a, b, e = self.unit[u], self.unit[u + 1], np.append(self.unit, len(self.code))[u + 2]
        alike = (self.code[a] == self.code[b]) & (self.code[b - 1] == self.code[e - 1])
        for i, x, y, z in zip(u[alike].tolist(), a[alike].tolist(), b[alike].tolist(), e[alike].tolist(), strict=True):
            left, right = self.code[x:y].tolist(), self.code[y:z].tolist()
            out[i] = left + right == right + left
        return out

    def transposed(self, requested: np.ndarray, rows: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n_applied and whether the text changes.  Pairs are taken in the order of their hashes unless a neighbour was;
        of a run of m neighbouring pairs at least a third are, so most texts need no hash."""
        place = np.flatnonzero(self.pair)
        if not len(place):
            return requested, requested > 0
        if not hasattr(self, "_equal"):
            self._equal = self.equal_pairs()
        begin = np.flatnonzero(np.append(True, np.diff(place) > 1))
        least = np.bincount(self.row[place[begin]], (np.diff(np.append(begin, len(place))) + 2) // 3, minlength=self.n)
        applied, changed = requested.copy(), requested > 0
        some = np.flatnonzero((requested[rows] > least[rows]) | ((requested[rows] > 0) & (requested[rows] <= self._count(self._equal)[rows])))
        n = self.eligible["char_transpose"]
        offset = np.cumsum(n) - n
        own = rows[some]
        if not len(own):
            return applied, changed
        lane, cell = _ranges(offset[own], n[own])
        u = place[lane]
        h = _hashes(states, some[cell], _places(1 << int(max(self.lengths())).bit_length()), u - self.first[own][cell] - 1)
        picked, top = picked_pairs(u, cell, h), _TOP
        size = np.bincount(cell[picked], minlength=len(own))
        applied[own] = np.minimum(requested[own], size)
        real = picked & ~self._equal[u]
        first = np.full(len(own), top)
        np.minimum.at(first, cell[real], h[real])
        ahead = np.bincount(cell[picked & (h < first[cell])], minlength=len(own))
        changed[own] = (applied[own] > 0) & (ahead < applied[own])
        return applied, changed

    def cell(self, noise_type: str, severity: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_eligible, n_requested, n_applied and changed by text."""
        requested, rows, states = self.requested(noise_type, severity, seed)
        if noise_type == "char_delete":
            applied = self.deleted(requested, rows, states)
            changed = applied > 0
        elif noise_type == "char_transpose":
            applied, changed = self.transposed(requested, rows, states)
        else:
            applied, changed = requested, requested > 0
        return self.eligible[noise_type], requested, applied, changed


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    held, letters = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            if x is None:
                continue
            held.append(unicodedata.normalize("NFC", x))
            letters += len(x)
            if letters >= LETTERS:
                yield held
                held, letters = [], 0
    if held:
        yield held


def rate_sums(df: DataFrame, severities: list[int], seeds: list[int], types: list[str] = maps.NOISE_TYPES, text: str = "text") -> DataFrame:
    """Sums over the texts with eligible units by type and severity, some rows each: see metrics.rate_terms."""
    for x in types:
        _check_type(x)
    fractions = {s: fraction(s) for s in severities}
    combining = marks(df.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(x, s): np.zeros(len(SUMS)) for x in types for s in severities}
        for texts in _chunks(batches):
            units = Units(texts, combining)
            for x, s in total:
                for seed in seeds:
                    n, asked, applied, changed = units.cell(x, s, seed)
                    asking = asked > 0
                    total[x, s] += [np.count_nonzero(n), n.sum(), asked.sum(), applied.sum(), np.count_nonzero(asking), (applied[asking] / asked[asking]).sum(), (n * fractions[s]).sum(), np.count_nonzero(changed)]
        found = [(x, s, v) for (x, s), v in total.items() if v[0]]
        columns = [pa.array([x for x, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.int32())]
        columns += [pa.array([float(v[k]) for _, _, v in found]).cast(pa.float64() if name in ("ratios", "nominal") else pa.int64()) for k, name in enumerate(SUMS)]
        yield pa.RecordBatch.from_arrays(columns, ["noise_type", "severity", *SUMS])

    kinds = ", ".join(f"{x} {'double' if x in ('ratios', 'nominal') else 'long'}" for x in SUMS)
    return spread(df.select(F.col(text).alias("text"))).mapInArrow(summed, f"noise_type string, severity int, {kinds}")
