"""Tokens and numbers of delimited text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The start of a text that is a number: blanks, sign, digits, fraction, exponent.
NUMBER = r"^[ \t]*([+-]?[0-9]*\.?[0-9]*)(?:[eE]([+-]?[0-9]+))?"
LARGEST_EXPONENT, LARGEST = 308, 1.7976931348623157e308


def tokens_or_empty(text: Column, delimiter: str = ",") -> Column:
    """Tokens with empty ones; an empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, re.escape(delimiter), -1)).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, delimiter: str = ",") -> Column:
    """Tokens where runs of delimiters count as one."""
    return F.array_remove(tokens_or_empty(text, delimiter), "")


def count_tokens(text: Column, delimiter: str = ",", empty: bool = False) -> Column:
    return F.size(tokens_or_empty(text, delimiter) if empty else tokens(text, delimiter))


def trimmed(text: Column) -> Column:
    """Without blanks at either end; a single character stays."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def numeric_prefix(text: Column) -> Column:
    """The number that text begins with, else 0: never null, never an error. Exponents beyond 308 count as 308.

    A text that is a finite decimal number as a whole is cast; only others go through the pattern.
    """
    mantissa, exponent = F.regexp_extract(text, NUMBER, 1), F.regexp_extract(text, NUMBER, 2)
    power = F.coalesce(exponent.try_cast("int"), F.when(exponent.startswith("-"), -LARGEST_EXPONENT).otherwise(LARGEST_EXPONENT))
    power = F.greatest(F.lit(-LARGEST_EXPONENT), F.least(F.lit(LARGEST_EXPONENT), power))
    written = F.when(exponent == "", mantissa).otherwise(F.concat(mantissa, F.lit("e"), power.cast("string")))
    prefix = F.coalesce(F.when(mantissa.rlike("[0-9]"), written).try_cast("double"), F.lit(0.0))
    whole = text.try_cast("double")
    decimal = (F.abs(whole) <= LARGEST) & ~F.contains(text, F.lit("x")) & ~F.contains(text, F.lit("X"))
    return F.when(decimal, whole).otherwise(prefix)


def strict_number(text: Column) -> Column:
    """The number that the whole text is, else null."""
    return trimmed(text).try_cast("double")
