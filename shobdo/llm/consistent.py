"""One consistent form for text that looks the same (problem 2).

Each token's resolved script set is the intersection, over its letters, of the scripts in which the
letter or a look-alike of it exists.  A non-empty intersection names the scripts the whole token can be
spelled in; Latin wins when it is among them (so whole-script confusables meet their Latin twin),
otherwise the token's only script does.  An empty intersection (a letter without any look-alike next to
foreign letters) respells the letters that have a Latin look-alike and leaves the rest.  Everything else is
compatibility normalisation: NFKC, default-ignorable characters dropped, white space of any kind and
width as one blank.

Defined results: null stays null; blank text becomes ''; no length limit; equal inputs give equal outputs and
the function is idempotent.  Joiners next to a virama and inside emoji sequences change what is seen and are
kept, except ta + virama + joiner, which is drawn as khanda ta.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (and letter variants) drawn like a basic Latin letter, after the
# public Unicode confusables data.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "E": "ΕЕᎬ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКᏦ",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "ΖᏃ", "G": "ԌᏀ", "D": "Ꭰ", "L": "Ꮮ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
}

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")
TO_LATIN = {c: latin for latin, cs in LOOKALIKES.items() for c in cs}


@lru_cache(maxsize=4096)
def script_of(ch: str) -> str:
    """The script named first in the character's Unicode name, '' outside the five handled ones."""
    first = unicodedata.name(ch, "").split(" ", 1)[0]
    return first if first in SCRIPTS else ""


#: (Latin letter, script) -> the look-alike in that script
SPELLED = {}
for _latin, _cs in LOOKALIKES.items():
    SPELLED[_latin, "LATIN"] = _latin
    for _c in _cs:
        SPELLED.setdefault((_latin, script_of(_c)), _c)


@lru_cache(maxsize=4096)
def scripts_for(ch: str) -> frozenset:
    """Scripts in which this letter can be written so that it looks the same."""
    latin = TO_LATIN.get(ch, ch)
    return frozenset({script_of(ch)} | {s for s in SCRIPTS if (latin, s) in SPELLED})


# Ranges of letters whose names carry those scripts, with the marks that may follow a base letter.
_EURO = "A-Za-zͰ-ϿЀ-ԯԱ-ֆɐ-ʯᎠ-Ᏼ"
_RUN = re.compile(f"[{_EURO}][{_EURO}\u0300-\u036f]*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯԱ-ֆɐ-ʯᎠ-Ᏼ]")
# Outside this, ASCII, Bengali and the common emoji need no look at all.
_ODD = re.compile("[^\t-\r -~।॥ঁ-৛৞ৠ-৻\U0001f300-\U0001f64f]|ে[াৗ]|অা|ঋৃ|়্")
_IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
)
_JOINER = "\u200c\u200d"
_EMOJI = "\u203c-\u3299\ufe0f\U0001f000-\U0001faff"
_DROP = re.compile(
    f"(?<=[{_EMOJI}])(\u200d)(?=[{_EMOJI}])|(?<=\u09cd)([{_JOINER}])(?=[\u0995-\u09b9])|([{_JOINER}])(?=\u09cd)|[{_IGNORABLE}]"
)


def _drop(m: re.Match) -> str:
    return m[1] or m[2] or m[3] or ""


def _respell(m: re.Match) -> str:
    run = m[0]
    if not _FOREIGN.search(run):
        return run
    letters = [c for c in run if not "\u0300" <= c <= "\u036f"]
    common = frozenset.intersection(*map(scripts_for, letters))
    if common == {"LATIN"} or "LATIN" in common or not common:
        return "".join(TO_LATIN.get(c, c) for c in run)
    to = next(s for s in SCRIPTS if s in common)
    return "".join(SPELLED.get((TO_LATIN.get(c, c), to), c) if script_of(c) != to else c for c in run)


def consistent(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    if _ODD.search(text):
        # drawn as khanda ta, also before a consonant
        text = text.replace("\u09a4\u09cd\u200d", "\u09ce")
        text = unicodedata.normalize("NFKC", _DROP.sub(_drop, text))
        text = text.replace("অা", "আ").replace("ঋৃ", "ৠ")
        if _FOREIGN.search(text):
            text = unicodedata.normalize("NFKC", _RUN.sub(_respell, unicodedata.normalize("NFKD", text)))
            text = text.replace("অা", "আ").replace("ঋৃ", "ৠ")
    return " ".join(text.split())


@F.pandas_udf(T.StringType())
def consistent_udf(s: pd.Series) -> pd.Series:
    return pd.Series([consistent(x) if x is not None else None for x in s], dtype=object)


def consistent_form(text: Column) -> Column:
    """Column form of :func:`consistent`."""
    return consistent_udf(text)


# ------------------------------------------------------------------ words of many texts at once

SPACE, PUNCT = 1, 2


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """uint8 by code point: 1 white space, 2 punctuation (categories P*), 0 the rest."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        if c.isspace():
            out[i] = SPACE
        elif unicodedata.category(c)[0] == "P":
            out[i] = PUNCT
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        _POWERS[base] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[base][:n]


class Words:
    """Words (see TESTDATA: pieces of the consistent form, lower case, outer punctuation off) of many texts.

    start, end: code point positions in the joined text; doc: index of the text; hash: 64 bits a word.
    """

    def __init__(self, texts: list[str | None]):
        self.joined = "\n".join([(consistent(t) or "").lower() if t else "" for t in texts])
        c = codes(self.joined)
        cls = char_classes()[c]
        solid = np.flatnonzero(cls == 0)
        space = cls == SPACE
        # words are told apart by the number of white spaces before each solid character
        gap = np.cumsum(space, dtype=np.int32)[solid]
        first = np.flatnonzero(np.diff(gap, prepend=-1))
        self.start = solid[first]
        self.end = solid[np.append(first[1:], len(solid)) - 1] + 1 if len(first) else solid[:0]
        ends = np.flatnonzero(c == 10)  # the consistent form has no line feed: these part the texts
        self.doc = np.searchsorted(ends, self.start).astype(np.int64)
        self.n_docs = len(texts)
        self.codes = c

    @property
    def hash(self) -> np.ndarray:
        """Polynomial hash of mixed code points; collisions are those of a random 64-bit function."""
        c, n = self.codes, len(self.codes)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        table = _mixed_codes()
        sums = np.zeros(n + 1, np.uint64)
        block = 1 << 20
        # blocks keep the tables of powers small; a word may cross them, so the sums run on
        lo, hi = _powers(_BASE, block), _powers(pow(_BASE, block, 1 << 64), n // block + 1)
        for k in range(0, n, block):
            part = table[np.minimum(c[k : k + block], 0x2FFFF)] * lo[: min(block, n - k)] * hi[k // block]
            np.cumsum(part, out=sums[k + 1 : k + 1 + len(part)])
            sums[k + 1 : k + 1 + len(part)] += sums[k]
        ilo, ihi = _powers(_INVERSE, block), _powers(pow(_INVERSE, block, 1 << 64), n // block + 1)
        return mix((sums[self.end] - sums[self.start]) * ilo[self.start % block] * ihi[self.start // block])

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def strings(self) -> list[str]:
        j = self.joined
        return [j[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


@lru_cache(maxsize=1)
def _mixed_codes() -> np.ndarray:
    return mix(np.arange(1, 0x30001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
