"""Cleaning and comparing field names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bracket kinds whose content is dropped, and characters that become a space
_BRACKETS = [r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", r"【[^】]*】", r"《[^》]*》"]
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_PUNCTUATION = r"[,;:，。；：']+"


def _squeeze(text: Column) -> Column:
    # (?U): the ideographic space counts as a blank
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip_blanks(text: Column) -> Column:
    """Without blanks of any kind at the ends: tabs, line ends and wide spaces count too."""
    return F.regexp_replace(text, BLANK_ENDS, "")


def clean_field_name(raw: Column) -> Column:
    """Lower-case name without bracketed parts, punctuation and inner dots; null becomes ''."""
    name = _squeeze(F.coalesce(raw, F.lit("")))
    for pattern in _BRACKETS:
        name = F.regexp_replace(name, pattern, "")
    name = F.regexp_replace(name, _PUNCTUATION, " ")
    name = F.regexp_replace(name, r"(?<=[a-zA-Z0-9])\.(?=[a-zA-Z0-9])", "")
    name = F.regexp_replace(name, r"(?<=[一-鿿])\.(?=[一-鿿])", "")
    return F.lower(_squeeze(name))


def compact_name(cleaned: Column) -> Column:
    """Only letters, digits and CJK characters of a cleaned name."""
    return F.regexp_replace(cleaned, r"[^a-z0-9一-鿿]", "")


def name_tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, by code points."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


@F.pandas_udf(T.DoubleType())
def matching_block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio, for callers that need this scorer instead of edit distance."""
    return pd.Series([
        difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)
    ], dtype="float64")
