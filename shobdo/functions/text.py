"""Text primitives: NFC, grapheme clusters, cleaning, character classes, validity. Null in, null out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import maps
from .dialect import Spark


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition (no built-in function has it)."""
    return pd.Series([x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x) for x in s], dtype=object)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return pd.Series([x if x is None else unicodedata.normalize("NFKC", x) for x in s], dtype=object)


def clusters(text: Column) -> Column:
    """Grapheme clusters of NFC text, a conjunct being one."""
    return F.regexp_extract_all(text, F.lit(maps.CLUSTER), F.lit(0))


def cluster_count(d: Spark, t: str) -> str:
    return d.occurrences(t, maps.CLUSTER)


#: Letters, numbers and the underscore
WORD = r"\p{L}\p{N}_"


def preprocess(d: Spark, t: str) -> str:
    """Cleaning of NFC text: links, then mentions, then white space. t is in NFC."""
    t = d.sub(t, rf"(?i)(^|[^{WORD}])(?:https?://|www\.)[^{maps.WS}]+", "$1<URL>")
    t = d.sub(t, rf"(^|[^{WORD}@])@[{WORD}\x{{0980}}-\x{{09FF}}]+", "$1<USER>")
    t = d.sub(t, f"[{maps.WS}]+", " ")
    return d.sub(t, "^ +| +$", "")


def char_class_patterns() -> dict[str, str]:
    """One Java pattern a class, disjoint: a character belongs to the first class that fits; the rest is 'other'."""
    return {
        "replacement": r"\x{FFFD}", "emoji": f"[{maps.EMOJI}]", "bengali": BENGALI, "latin": LATIN, "digit": DIGIT,
        "punctuation": PUNCTUATION, "whitespace": f"[{maps.WS}]",
    }


def char_class_counts(d: Spark, t: str) -> dict[str, str]:
    """Characters of each class."""
    return {k: d.occurrences(t, p) for k, p in char_class_patterns().items()}


# Classes of Java's regular expressions; a character belongs to the first that fits
BENGALI = r"\p{IsBengali}"
LATIN = r"\p{IsLatin}"
#: Numerals that are digits without being decimal ones (superscripts, circled digits), by the Unicode database
_DIGITS = "".join(rf"\x{{{i:x}}}" for i in range(0x20000) if unicodedata.category(chr(i)) == "No" and chr(i).isdigit())
DIGIT = rf"[\p{{Nd}}{_DIGITS}&&[^\p{{IsBengali}}{maps.EMOJI}]]"
PUNCTUATION = rf"[\p{{P}}&&[^\p{{IsBengali}}{maps.EMOJI}]]"


def orphan_nukta(d: Spark, t: str) -> str:
    return d.like(t, r"(^|[^\p{Lo}])\x{09BC}")


def valid_output(d: Spark, t: str, normal: str) -> str:
    """No lost character, NFC, no orphan nukta, no combining mark at the start or after white space."""
    return f"(NOT {d.like(t, chr(92) + 'x{FFFD}')} AND {normal} = {t} AND NOT {orphan_nukta(d, t)} AND NOT {d.like(t, rf'(^|[{maps.WS}])' + chr(92) + 'p{M}')})"
