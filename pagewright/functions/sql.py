"""Small Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Runs of letters and digits of any script.
WORD_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; NULL text gives NULL."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def blanks_split(text: Column) -> Column:
    """Runs of non-whitespace (Unicode whitespace)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 times the number of whitespace-separated words."""
    return F.floor(F.size(blanks_split(text)) * F.lit(1.3).cast("double")).cast("int")


def one_space(text: Column) -> Column:
    """Trimmed, with each whitespace run as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))
