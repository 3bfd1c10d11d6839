"""Character classes for the SQL that checks the queries, made from Python's Unicode database and not from the patterns
the operators use."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from ..functions import maps

LAST = 0x20000


def ranges(wanted: Callable[[str], bool]) -> str:
    """The inside of a character class of RE2."""
    out, begin = [], None
    for i in range(LAST + 1):
        hit = i < LAST and not 0xD800 <= i < 0xE000 and wanted(chr(i))
        if hit and begin is None:
            begin = i
        elif not hit and begin is not None:
            out.append(rf"\x{{{begin:x}}}-\x{{{i - 1:x}}}" if i - 1 > begin else rf"\x{{{begin:x}}}")
            begin = None
    return "".join(out)


def _taken(c: str) -> bool:
    """Emoji and Bengali letters, signs and digits come before digits and punctuation."""
    return any(a <= ord(c) <= b for a, b in maps.EMOJI_RANGES) or unicodedata.name(c, "").startswith("BENGALI ")


WORD = ranges(lambda c: c.isalnum() or c == "_")
SPACE = ranges(str.isspace)
CLASSES = {
    "replacement": r"\x{FFFD}",
    "emoji": "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in maps.EMOJI_RANGES) + "]",
    "bengali": r"\p{Bengali}",
    "latin": r"\p{Latin}",
    "digit": "[" + ranges(lambda c: c.isdigit() and not _taken(c)) + "]",
    "punctuation": "[" + ranges(lambda c: unicodedata.category(c)[0] == "P" and not _taken(c)) + "]",
    "whitespace": f"[{SPACE}]",
}


def count(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{pattern}')) AS INT)"


def cleaned(t: str) -> str:
    """Links, mentions and white space of NFC text."""
    links = rf"regexp_replace({t}, '(?i)(^|[^{WORD}])(https?://|www\.)[^{SPACE}]+', '\1<URL>', 'g')"
    mentions = rf"regexp_replace({links}, '(^|[^@{WORD}])@[{WORD}\x{{0980}}-\x{{09FF}}]+', '\1<USER>', 'g')"
    return f"trim(regexp_replace({mentions}, '[{SPACE}]+', ' ', 'g'), ' ')"


def valid(t: str) -> str:
    lead = rf"(^|[{SPACE}])\p{{M}}"
    return rf"NOT contains({t}, chr(65533)) AND nfc_normalize({t}) = {t} AND NOT ({orphan(t)}) AND NOT regexp_matches({t}, '{lead}')"


def orphan(t: str) -> str:
    return rf"regexp_matches({t}, '(^|[^\p{{Lo}}])\x{{09BC}}')"


def erfc(z: str) -> str:
    """Complementary error function of z >= 0: a series below 1.5, a continued fraction beyond."""
    series = f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({z}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))"
    fraction = f"(exp(-{z} * {z}) / sqrt(pi()) / list_reduce(list_transform(range(120, 0, -1), lambda k: k::DOUBLE), lambda acc, k: {z} + (k / 2) / acc, {z}::DOUBLE))"
    return f"(CASE WHEN {z} < 1.5 THEN {series} ELSE {fraction} END)"


def mcnemar_p(b: str, c: str) -> str:
    """Exact two-sided binomial below 25 discordant pairs, else chi-square with continuity correction."""
    n = f"({b} + {c})"
    exact = f"least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({b}, {c}) AS BIGINT) + 1), lambda i: gamma({n} + 1) / (gamma(i + 1) * gamma({n} - i + 1)))) / pow(2.0, {n}))"
    return f"(CASE WHEN {n} = 0 OR ({n} < 25 AND {b} = {c}) THEN 1.0 WHEN {n} < 25 THEN {exact} ELSE {erfc(f'sqrt(pow(abs({b} - {c}) - 1, 2) / {n} / 2)')} END)"
