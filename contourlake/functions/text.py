"""Text functions for tone languages: tone-bearing units, normalisers and error rates.

Spark has no Unicode normalisation. The rules here concern single letters and
their marks, so each becomes a finite translation over the precomposed letters
of the Latin blocks, derived from the Unicode database when the module loads.
Loose combining marks are translated on their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACUTE, GRAVE, MACRON = "\u0301", "\u0300", "\u0304"
TONE_OF_MARK = {ACUTE: "H", GRAVE: "L", MACRON: "M"}
VOWELS = frozenset("aeiou")
#: Private-use stand-ins for tone classes, so that the letters H, M and L of a text cannot be taken for tones.
STAND_IN = {"H": "\ue001", "M": "\ue002", "L": "\ue003"}
LATIN = (*range(0x41, 0x250), *range(0x1E00, 0x1F00))


def tone_of_letter(letter: str) -> str | None:
    """H, M or L of a tone-bearing letter: by its first tone mark, else M for a vowel; None for other letters."""
    first, *marks = unicodedata.normalize("NFD", letter)
    tone = next((TONE_OF_MARK[m] for m in marks if m in TONE_OF_MARK), None)
    if tone is None and first.lower() in VOWELS:
        return "M"
    return tone


@cache
def tone_letters() -> dict[str, str]:
    return {chr(c): t for c in LATIN if chr(c).isalpha() and (t := tone_of_letter(chr(c)))}


@cache
def bare_letters() -> dict[str, str]:
    """Letters with marks, and what is left without them."""
    return {chr(c): b for c in LATIN if (b := unicodedata.normalize("NFD", chr(c))[0]) != chr(c) and len(b) == 1}


@cache
def swapped_letters() -> dict[str, str]:
    """Letters with an acute or a grave accent, and the letters with the other."""
    out = {}
    for c in LATIN:
        marks = unicodedata.normalize("NFD", chr(c))
        other = unicodedata.normalize("NFC", marks.translate({ord(ACUTE): GRAVE, ord(GRAVE): ACUTE}))
        if other != chr(c) and len(other) == 1:
            out[chr(c)] = other
    return out | {ACUTE: GRAVE, GRAVE: ACUTE}


def align_text(text: str) -> tuple[str, list[int], str]:
    """What an aligner hears of a text: lower case without tone marks, other marks kept and composed; the place in it of each tone-bearing unit; the units' tones."""
    flat, places, tones = [], [], []
    size = 0
    clusters: list[str] = []
    for c in unicodedata.normalize("NFD", text):
        if clusters and unicodedata.combining(c):
            clusters[-1] += c
        else:
            clusters.append(c)
    for c in clusters:
        kept = unicodedata.normalize("NFC", "".join(x for x in c if x not in TONE_OF_MARK)).lower()
        tone = tone_of_letter(c) if c[0].isalpha() else None
        if tone is not None and kept:
            places.append(size)
            tones.append(tone)
        flat.append(kept)
        size += len(kept)
    return "".join(flat), places, "".join(tones)


def _translated(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def marked_units(text: Column) -> Column:
    """The text with each tone-bearing letter as its tone's stand-in; a loose mark after a letter gives the letter's tone."""
    whole = _translated(text, {k: STAND_IN[v] for k, v in tone_letters().items()})
    loose = whole
    for mark, tone in TONE_OF_MARK.items():
        loose = F.regexp_replace(loose, f"(?:\\p{{L}}|{STAND_IN['M']})[\\x{{302}}\\x{{303}}\\x{{305}}-\\x{{36F}}]*{mark}", STAND_IN[tone])
    return F.when(text.contains(ACUTE) | text.contains(GRAVE) | text.contains(MACRON), loose).otherwise(whole)


def tone_letters_of(text: Column) -> Column:
    """The tones of a text's tone-bearing units, in order, as a string of H, M, L."""
    only = F.regexp_replace(marked_units(text), f"[^{''.join(STAND_IN.values())}]", "")
    return F.translate(only, "".join(STAND_IN.values()), "".join(STAND_IN))


def tone_sequence(text: Column) -> Column:
    """The tones of a text's tone-bearing units, in order, as an array of H, M, L."""
    letters = tone_letters_of(text)
    return F.when(letters == "", F.array().cast("array<string>")).otherwise(F.split(letters, ""))


def tone_counts(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """n_h, n_m and n_l of each key; a text's tones are found once and counted three times."""
    tones = docs.select(*keys, tone_letters_of(F.col(text)).alias("_t"))
    return tones.groupBy(*keys).agg(*(F.sum(F.length("_t") - F.length(F.replace("_t", F.lit(t), F.lit("")))).cast("long").alias(f"n_{t.lower()}") for t in TONE_OF_MARK.values()))


def tone_bigrams(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """bigram and n of each key: how often a tone follows another within a text.

    Two unequal tones cannot overlap themselves, so what a text loses without
    them counts them. A tone follows itself wherever it neither begins the text
    nor follows another.
    """
    tones = docs.select(*keys, tone_letters_of(F.col(text)).alias("_t"))
    lost = lambda part: (F.length("_t") - F.length(F.replace("_t", F.lit(part), F.lit("")))).cast("long")
    names = list(TONE_OF_MARK.values())
    sums = [F.sum(lost(t)).alias(f"_{t}") for t in names] + [F.sum(F.col("_t").startswith(t).cast("long")).alias(f"_s{t}") for t in names]
    unequal = [a + b for a in names for b in names if a != b]
    counted = tones.groupBy(*keys).agg(*sums, *((F.sum(lost(p)) / 2).cast("long").alias(f"_{p}") for p in unequal))
    own = {t + t: F.col(f"_{t}") - F.col(f"_s{t}") - sum((F.col(f"_{p}") for p in unequal if p[1] == t), F.lit(0)) for t in names}
    each = F.array(*(F.struct(F.lit(p).alias("bigram"), n.alias("n")) for p, n in ({p: F.col(f"_{p}") for p in unequal} | own).items()))
    return counted.select(*keys, F.explode(each).alias("_p")).select(*keys, "_p.*").where("n > 0")


def flat_for_align(text: Column) -> Column:
    """Lower-cased text without tone marks; dots below and other marks stay."""
    table = {}
    for c in LATIN:
        marks = unicodedata.normalize("NFD", chr(c))
        kept = unicodedata.normalize("NFC", "".join(m for m in marks if m not in TONE_OF_MARK))
        if kept != chr(c) and len(kept) == 1:
            table[chr(c)] = kept
    return F.lower(F.translate(_translated(text, table), "".join(TONE_OF_MARK), ""))


def strip_marks(text: Column) -> Column:
    """The text without any marks."""
    return F.regexp_replace(_translated(text, bare_letters()), "[\\x{300}-\\x{36F}]", "")


def composed(text: Column) -> Column:
    """The text in Unicode's composed form (NFC), by the ICU library that Spark ships."""
    icu = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike("[^\\x00-\\x7F]"), icu).otherwise(text)


def norm_key(text: Column) -> Column:
    """Composed, lower case, white space collapsed: the key of holdouts."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), r"\s+", " "))


def cer_text(text: Column) -> Column:
    """What error rates compare: no marks, lower case, punctuation as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), r"[^\p{L}\p{N}_]+", " "))


def plain_text(text: Column) -> Column:
    """The toneless normaliser: lower case, punctuation as spaces, spaces collapsed, marks kept."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+", " "))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edits over the reference's length; an empty reference gives 0 for an empty hypothesis, else 1. May exceed 1."""
    r, h = cer_text(reference), cer_text(hypothesis)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def swap_tones(text: Column) -> Column:
    """Acute and grave accents exchanged."""
    return _translated(text, swapped_letters())


def fill_carrier(template: Column, word: Column) -> Column:
    """The template with the word in its gap."""
    return F.replace(template, F.lit("___"), word)


def first_replaced(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of old as new: a homograph's variant."""
    at = F.locate(old, text) if isinstance(old, str) else F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def bad_tags(tags: Column, valid: list[str]) -> Column:
    """The tags, split at commas of either width, that are not valid."""
    named = F.filter(F.transform(F.split(F.lower(tags), "[,\uff0c]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(named, F.array(*map(F.lit, valid)))
