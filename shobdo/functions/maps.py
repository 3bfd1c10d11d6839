"""Constants of the noise operators and text classes, all in NFC."""

from __future__ import annotations

import unicodedata


def _chars(*ranges: tuple[int, int]) -> list[str]:
    return [chr(c) for a, b in ranges for c in range(a, b + 1)]


NUKTA, HASANTA, CHANDRABINDU = "়", "্", "ঁ"
# Severity -> fraction of eligible units
FRACTIONS = {1: 0.05, 2: 0.10, 3: 0.20, 4: 0.35, 5: 0.50}
# Fixed values, down to SIGNS and INSERTABLE: the letters by kind
NUKTA_LETTERS = ["ড়", "ঢ়", "য়"]
CONSONANTS = _chars((0x995, 0x9A8), (0x9AA, 0x9B0), (0x9B2, 0x9B2), (0x9B6, 0x9B9)) + NUKTA_LETTERS
VOWELS = _chars((0x985, 0x98B), (0x98F, 0x990), (0x993, 0x994))
MATRAS = _chars((0x9BE, 0x9C3), (0x9C7, 0x9C8), (0x9CB, 0x9CC))
SIGNS = ["ঁ", "ং", "ঃ", "ৎ"]
DIGITS = _chars((0x9E6, 0x9EF))
INSERTABLE = CONSONANTS + VOWELS + ["ং", "ঃ", "ৎ"]
COMBINING = [*MATRAS, HASANTA, NUKTA, "ৗ", "ঁ", "ং", "ঃ"]
# Sets of letters that sound alike
HOMOPHONES = [
    ["শ", "ষ", "স"], ["ন", "ণ"], ["ই", "ঈ"], ["উ", "ঊ"], ["ি", "ী"], ["ু", "ূ"],
    ["র", "ড়", "ঢ়"], ["জ", "য"],
]
# What may be dropped or altered, and the vowels of vowel signs
DROP_TARGETS = [*MATRAS, HASANTA, CHANDRABINDU]
ALTER = {"ি": "ী", "ী": "ি", "ু": "ূ", "ূ": "ু"}
MATRA_VOWEL = {"ু": "উ", "ূ": "ঊ", "ি": "ই", "ী": "ঈ", "ো": "ও"}
# Emoji ranges and what glues sequences
EMOJI_RANGES = [
    (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF),
    (0x2600, 0x26FF), (0x2700, 0x27BF), (0x1F1E6, 0x1F1FF), (0x1F000, 0x1F02F),
]
EMOJI_GLUE = "‍️︎⃣"
# Label of an emoji without a name, noise types in their order and groups, seeds
EMOJI_FALLBACK = ":emoji:"
NOISE_TYPES = [
    "char_insert", "char_delete", "char_substitute", "char_transpose", "homophone_confuse",
    "matra_perturb", "conjunct_split", "elongate", "whitespace_error",
]
NOISE_GROUPS = {"A": NOISE_TYPES[:4], "B": NOISE_TYPES[4:8], "C": NOISE_TYPES[8:]}
SEEDS = [42, 1337, 2024]
# Targets of the ratios of neighbouring severities
TARGET_RATIOS = [2.0, 2.0, 1.75, 1.43]
CHAR_CLASSES = ["replacement", "emoji", "bengali", "latin", "digit", "punctuation", "whitespace", "other"]
CER_CAP = 300

# Character classes as regular-expression text that Java and RE2 read alike
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EMOJI = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in EMOJI_RANGES)
_C = r"\x{0995}-\x{09A8}\x{09AA}-\x{09B0}\x{09B2}\x{09B6}-\x{09B9}\x{09DC}\x{09DD}\x{09DF}\x{09F0}\x{09F1}"
_E = r"\x{0981}\x{09BC}\x{09BE}\x{09C1}-\x{09C4}\x{09CD}\x{09D7}\x{09E2}\x{09E3}\x{09FE}\x{200D}"
#: One grapheme cluster, conjuncts whole
CLUSTER = rf"(?s)\r\n|[\r\n]|(?:[{_C}](?:[{_E}]*\x{{09CD}}[{_E}]*[{_C}])*|.)[\p{{M}}\x{{200C}}\x{{200D}}]*"
CONSONANT_POINT = r"[\x{0995}-\x{09A8}\x{09AA}-\x{09B0}\x{09B2}\x{09B6}-\x{09B9}]"


def emoji_label(ch: str) -> str:
    """`:name:` of one emoji from the Unicode database."""
    name = unicodedata.name(ch, "").lower()
    slug = "_".join(x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in name).split())
    return f":{slug}:" if slug else EMOJI_FALLBACK


def check() -> None:
    """Sizes and disjointness that the operators rely on."""
    assert (len(CONSONANTS), len(VOWELS), len(MATRAS), len(DIGITS), len(INSERTABLE)) == (35, 11, 10, 10, 49)
    pools = [*CONSONANTS, *VOWELS, *MATRAS, *SIGNS, *DIGITS]
    assert len(set(pools)) == len(pools)
    assert all(unicodedata.normalize("NFC", x) == x for x in pools)
    members = [m for s in HOMOPHONES for m in s]
    assert len(set(members)) == len(members) and all(len(s) >= 2 for s in HOMOPHONES)
    assert all(ALTER[ALTER[m]] == m for m in ALTER) and set(ALTER) <= set(MATRAS)
    assert set(MATRA_VOWEL) <= set(MATRAS) and set(MATRA_VOWEL.values()) <= set(VOWELS)
    assert len(DROP_TARGETS) == 12 and sorted(FRACTIONS) == [1, 2, 3, 4, 5]
