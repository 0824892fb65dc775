"""Scalar text functions as column expressions: folding, OCR digits, identifier tests, strict parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def _fold_table() -> tuple[str, str]:
    """Letters up to U+017F and compatibility marks whose decomposition is one base character, and that character."""
    pairs = {"º": "o", "ª": "a", NBSP: " "}
    for code in range(0xC0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
#: Letters read for digits by OCR.
OCR_FROM, OCR_TO = "OoIlSsg", "0011559"


def fold_accents(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize_words(c: Column) -> Column:
    """Lower case, no accents, single spaces, ``rn`` read as ``m``; digits untouched."""
    return F.regexp_replace(F.trim(F.regexp_replace(fold_accents(F.lower(c)), "\\s+", " ")), "rn", "m")


def raw_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def ocr_digits(c: Column) -> Column:
    """Digits, letters that OCR puts for digits read as those."""
    return raw_digits(F.translate(c, OCR_FROM, OCR_TO))


def is_identifier_noise(c: Column) -> Column:
    """Only digits, ``. - / ° º`` and white space."""
    return c.rlike(f"^[0-9.\\-/°º\\s{NBSP}]*$")


def class_text(c: Column) -> Column:
    """Text of a class name: digits and number punctuation out, then normalised."""
    return normalize_words(F.regexp_replace(c, "[0-9/º°\\-.,]", " "))


def group_by_three(c: Column, sep: str = ".") -> Column:
    """Digits in groups of three from the right."""
    return F.reverse(F.regexp_replace(F.reverse(c), "(.{3})(?=.)", f"$1{sep}"))


def plain_id(c: Column) -> Column:
    """Trimmed; an id of digits alone without leading zeros (``000`` is ``0``)."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(t)


def strict_int(c: Column) -> Column:
    """The integer, null where the text is none."""
    t = F.trim(c)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))


def probability(c: Column) -> Column:
    """A number in [0, 1], null where the text is none."""
    x = F.trim(c).try_cast("double")
    return F.when((x >= 0) & (x <= 1), x)


def has_stop_word(c: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), "[^a-z]+"), F.array(*(F.lit(w) for w in words)))
