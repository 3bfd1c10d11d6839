"""Garbled text from wrong character decoding (problem 3).

The garbled forms of every distinct clean word of the corpus and of the pieces of such words (grapheme clusters and
single signs outside ASCII), under all chains of wrong decodings, are generated and joined by hash with the suspicious
tokens of the texts and with their pieces; a match names the verified original.  Tokens are cut into pieces where a
suspicious run meets other text and, within a run, where one garbled cluster or sign ends and the next begins; the places of these cuts
come from a table of single signs that is fixed by rule.  Only a run that is wholly made of signs which no word of the
corpus carries is taken on that table's word alone (`by` = 'sign').  U+FFFD marks a wrong decoding whether or not the
original can be regained.

A token is a piece between blanks, tabs and line ends (garbled text holds other white space), without the ASCII
punctuation around it.  Defined results: null and empty texts are never garbled; a form that several words have stands for
the most frequent (then the first by spelling); a form of nothing but look-alikes of Latin letters and white space is a
spelling and no form; text without garbled tokens is returned unchanged; any length.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .consistent import TO_LATIN

LOST = "�"
# Chains of wrong decodings of UTF-8 bytes; '?' marks bytes that have no character as lost,
# otherwise they pass as control characters.
CHAINS = (
    ("latin-1",), ("cp1252",), ("cp1252?",), ("cp1251",), ("cp1251?",), ("mac_roman",), ("cp437",),
    ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252?", "cp1252?"),
)
#: Rows without such a character hold nothing garbled (a Java and a Python pattern)
_CLEAN = r"\x00-\x7f।॥ঀ-৿​-‍⁠﻿＀-￯"
SUSPECT = re.compile(f"[^{_CLEAN}\U0001f300-\U0001faff]")
SUSPECT_JAVA = f"[^{_CLEAN}\\x{{1f300}}-\\x{{1faff}}]"
_BLANK = re.compile("([ \t\r\n]+)")
_RUN = re.compile("[^\x00-\x7f।॥ঀ-৿]+")
_EDGE = string.punctuation
_CLUSTER = regex.compile(r"\X")
_MARK = regex.compile(r"[\p{M}\u200c\u200d]")


@lru_cache(maxsize=32)
def decoding(name: str) -> list[str]:
    """The character of each byte."""
    lossy = name.endswith("?")
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name.rstrip("?")))
        except UnicodeDecodeError:
            out.append(LOST if lossy else chr(b))
    return out


def garble(text: str, chain: tuple[str, ...]) -> str:
    for name in chain:
        t = decoding(name)
        text = "".join([t[b] for b in text.encode("utf-8", "surrogatepass")])
    return text


def _says_nothing(form: str) -> bool:
    """Only lost signs, or a possible spelling: look-alikes of Latin letters (see consistent) and white space."""
    return not form.strip(LOST) or all(c in TO_LATIN or c.isspace() for c in form)


def forms(word: str) -> set[str]:
    """All garbled forms of a word, without those that say nothing (the word itself as well)."""
    return {g for c in CHAINS if (g := garble(word, c)) != word and not _says_nothing(g)}


@lru_cache(maxsize=1)
def sign_forms() -> dict[str, tuple[str, int]]:
    """Garbled form -> original and chain of single characters that the corpus's texts are written with."""
    ranges = ((0xA0, 0x24F), (0x300, 0x308), (0x964, 0x965), (0x980, 0x9FE), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x2100, 0x2190),
              (0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x1F300, 0x1FAFF), (0x200B, 0x200D), (0xFEFF, 0xFEFF))
    out: dict[str, tuple[str, int]] = {}
    for a, b in ranges:
        for cp in range(a, b + 1):
            for k, chain in enumerate(CHAINS):
                g = garble(chr(cp), chain)
                if LOST not in g and not _says_nothing(g):
                    out.setdefault(g, (chr(cp), k))
    return out


@lru_cache(maxsize=200_000)
def units(run: str) -> list[tuple[str, str | None]]:
    """The run cut into garbled signs with their originals (the longest form at each place wins) and other characters (None)."""
    table = sign_forms()
    out, i = [], 0
    while i < len(run):
        for size in range(min(len(run) - i, 16), 1, -1):
            hit = table.get(run[i : i + size])
            if hit:
                out.append((run[i : i + size], hit[0]))
                i += size
                break
        else:
            out.append((run[i], None))
            i += 1
    return out


def restore_run(run: str) -> tuple[str, bool, bool]:
    """The run with garbled characters replaced; whether any was; whether all suspicious characters are accounted for."""
    found = units(run)
    return "".join([o or c for c, o in found]), any(o for _, o in found), not any(o is None and SUSPECT.match(c) for c, o in found)


def pieces(core: str) -> list[str]:
    """What is looked up for a suspicious token: itself, its suspicious runs, and their garbled clusters and signs."""
    out = {core: None}
    for run in _RUN.findall(core):
        out[run] = None
        cluster = ""
        for form, original in [*units(run), ("", None)]:
            if not original or not _MARK.match(original):
                if cluster:
                    out[cluster] = None
                cluster = ""
            if original:
                out[form] = None
                cluster += form
    return [x for x in out if len(x) > 1 and SUSPECT.search(x)]


def restore_token(token: str) -> tuple[str, bool, bool]:
    """As restore_run, for all runs of a token."""
    found, whole = False, True

    def sub(m: re.Match) -> str:
        nonlocal found, whole
        text, any_, all_ = restore_run(m[0])
        found |= any_
        whole &= all_ or not any_
        return text if any_ else m[0]

    text = _RUN.sub(sub, token)
    # a second round undoes chains that mix at the level of signs
    if found and _RUN.search(text):
        text = _RUN.sub(lambda m: restore_run(m[0])[0], text)
    return text, found, whole and LOST not in token


def core_of(token: str) -> tuple[str, str, str]:
    core = token.strip(_EDGE)
    at = token.find(core) if core else len(token)
    return token[:at], core, token[at + len(core) :]


def _is_clean(word: str) -> bool:
    return LOST not in word and not (SUSPECT.search(word) and restore_token(word)[1])


def parts(word: str) -> set[str]:
    """Grapheme clusters and single characters outside ASCII of a clean word; white space is none."""
    return {x for c in _CLUSTER.findall(word) for x in (c, *c) if not x.isascii() and not x.isspace()}


def _words(batches):
    """word, n: clean words with a character outside ASCII and their parts, counted before the shuffle."""
    seen: Counter = Counter()

    def out():
        words = Counter()
        for w, n in seen.items():
            core = w.strip(_EDGE)
            if core and not core.isascii() and _is_clean(core):
                words[core] += n
                for x in parts(core):
                    words[x] += 0  # a whole word of that form goes first
        seen.clear()
        return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                seen.update(t.split(" "))
        if len(seen) > 300_000:
            yield out()
    yield out()


def _forms(batches):
    for batch in batches:
        word, form, n = [], [], []
        for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for g in forms(w):
                word.append(w)
                form.append(g)
                n.append(k)
        yield pa.RecordBatch.from_pydict({"form": form, "word": word, "n": n}, schema=pa.schema([("form", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def garbled_forms(records: DataFrame) -> DataFrame:
    """form, original: the garbled forms of every distinct clean word, one original a form."""
    words = records.select("text").where("text is not null").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    made = words.mapInArrow(_forms, "form string, word string, n bigint")
    return made.groupBy("form").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("original"))


_TOKENS = "record_id bigint, place int, core string, restored string, found boolean, whole boolean, pieces array<string>"


def _suspicious(batches):
    """Tokens with a suspicious character, their pieces, and what the table of signs makes of them."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for place, piece in enumerate(_BLANK.split(text)):
                if place % 2 or not SUSPECT.search(piece):
                    continue
                core = core_of(piece)[1]
                for c, v in zip(cols, (key, place, core, *restore_token(core), pieces(core)), strict=True):
                    c.append(v)
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
        names = ("record_id", "place", "core", "restored", "found", "whole", "pieces")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(names))


def garbled_tokens(records: DataFrame) -> DataFrame:
    """record_id, place, core, original (null: not regained), by, of every garbled token of every row.

    by: 'word' where a form of a clean word is the token, 'piece' where forms of words or of their parts are in it,
    'sign' where only the table of signs knows all of its suspicious characters, 'lost' where U+FFFD is all there is."""
    suspects = records.where((F.col("text").rlike(SUSPECT_JAVA)) & F.col("record_id").isNotNull()).select("record_id", "text")
    tokens = cut(suspects.mapInArrow(_suspicious, _TOKENS))
    # the table is joined to distinct pieces of distinct tokens, so a garbled word that many rows repeat is one row
    distinct = tokens.groupBy("core").agg(F.any_value("pieces").alias("pieces"))
    wanted = distinct.select("core", F.explode("pieces").alias("form"))
    known = wanted.join(garbled_forms(records), "form").groupBy("core").agg(F.max(F.when(F.col("form") == F.col("core"), F.col("original"))).alias("original"), F.lit(True).alias("joined"))
    lost = F.col("core").contains(LOST)
    by = F.when(F.col("original").isNotNull(), "word").when(F.col("joined"), "piece").when(F.col("found") & (F.col("whole") | lost), "sign").when(lost, "lost")
    out = tokens.join(known, "core", "left").withColumn("by", by).where(F.col("by").isNotNull())
    return out.select("record_id", "place", "core", F.coalesce("original", F.expr(f"if(found and whole and not contains(restored, '{LOST}'), restored, null)")).alias("original"), "by")


def garbled_records(records: DataFrame) -> DataFrame:
    """record_id of every row that holds a garbled token."""
    return garbled_tokens(records).select("record_id").distinct()


def methods(records: DataFrame) -> DataFrame:
    """by, n_tokens, n_records: what the garbled tokens were found by."""
    return garbled_tokens(records).groupBy("by").agg(F.count("*").alias("n_tokens"), F.countDistinct("record_id").alias("n_records"))


def _rebuild(batches):
    for batch in batches:
        ids, texts, places, words, lost = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for text, ps, ws in zip(texts, places, words, strict=True):
            pieces = _BLANK.split(text)
            for p, w in zip(ps, ws, strict=True):
                before, core, after = core_of(pieces[p])
                pieces[p] = before + (core if w is None else w) + after
            out.append("".join(pieces))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(lost, pa.int32())], ["record_id", "text", "n_lost"])


def restored_texts(records: DataFrame) -> DataFrame:
    """record_id, text, n_lost: garbled rows with originals substituted; n_lost tokens could not be regained."""
    g = garbled_tokens(records).groupBy("record_id").agg(F.collect_list(F.struct("place", "original")).alias("t"), F.count_if(F.col("original").isNull()).cast("int").alias("n_lost"))
    full = records.select("record_id", "text").where("text is not null").join(g, "record_id")
    return full.select("record_id", "text", "t.place", "t.original", "n_lost").mapInArrow(_rebuild, "record_id bigint, text string, n_lost int")
