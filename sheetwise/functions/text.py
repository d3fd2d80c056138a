"""Text functions as column expressions."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import Config


def normalized(text: Column, config: Config) -> Column:
    """White space joined, decimal commas and trailing zeros levelled, symbols in their canonical form; in this order."""
    out = text
    if config.collapse_whitespace:
        out = F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))
    if config.case_insensitive:
        out = F.upper(out)
    if config.decimal_separator_equiv:
        out = F.regexp_replace(out, r"(?U)(?<=\d),(?=\d)", ".")
    if config.strip_trailing_zeros:
        out = F.regexp_replace(out, r"(?U)(\d+\.\d*?)0+\b", "$1")
        out = F.regexp_replace(out, r"(?U)(\d+)\.(?=\D|$)", "$1")
    for member, canonical in config.replacements():
        out = F.replace(out, F.lit(member), F.lit(canonical))
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two normalised texts over the longer one's length; equal texts skip it."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double"))


def contains_any(text: Column, words: list[str]) -> Column:
    """One pattern, so that the text is worked out once."""
    return text.rlike("|".join(map(re.escape, words)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_key(name: Column) -> Column:
    """Names that differ in case only have one key."""
    return F.lower(F.upper(F.lower(name)))


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """template with {slot} filled in once: what a filled text says is not read again."""
    parts = F.split(template, r"(?=\{(?:" + "|".join(slots) + r")\})|(?<=\{(?:" + "|".join(slots) + r")\})")

    def one(part: Column) -> Column:
        out = part
        for name, value in slots.items():
            out = F.when(part == "{" + name + "}", value).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as difflib tells it."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")
