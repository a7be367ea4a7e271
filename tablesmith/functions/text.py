"""Native expressions that read booleans, numbers and money from dirty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .lexicon import CLEAN_FALSE, CLEAN_TRUE, CURRENCY_MARKS

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# A leading minus at most, one point at most and a digit somewhere, between any other characters.
_AMOUNT = r"^(?=[^0-9]*[0-9])[^0-9.\-]*-?[^.\-]*(?:\.[^.\-]*)?$"
_NOT_NUMBER_CHARS = r"[^0-9.\-]+"


def trim_spaces(c: Column) -> Column:
    """Strip both ends and turn every run of Unicode whitespace into one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strict_double(c: Column) -> Column:
    """Text to double, null unless the whole text is a number (a bare cast would take ``5d``)."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def to_bool(c: Column) -> Column:
    """Yes/no words in Korean or English to boolean, null for any other text."""
    word = F.upper(F.trim(c))
    return F.when(word.isin(CLEAN_TRUE), F.lit(True)).when(word.isin(CLEAN_FALSE), F.lit(False))


def has_digit(c: Column) -> Column:
    """True where the text holds a digit; without one it is neither number, amount nor date."""
    return F.coalesce(c.rlike("[0-9]"), F.lit(False))


def _contains_any(c: Column, marks: list[str]) -> Column:
    # Plain substring searches run on the bytes of the text; a pattern of alternatives is far slower.
    return reduce(lambda found, mark: found | F.contains(c, F.lit(mark)), marks[1:], F.contains(c, F.lit(marks[0])))


def has_currency(c: Column) -> Column:
    return F.coalesce(_contains_any(c, [m for marks in CURRENCY_MARKS.values() for m in marks]), F.lit(False))


def is_amount(c: Column) -> Column:
    """True where a number is left after every character but digits, point and minus is deleted."""
    return F.coalesce(c.rlike(_AMOUNT), F.lit(False))


def to_amount(c: Column) -> Column:
    """Amount left after every character but digits, point and minus is deleted."""
    return F.when(c.rlike(_AMOUNT), F.regexp_replace(c, _NOT_NUMBER_CHARS, "").try_cast("double"))


def _without_commas(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit(","), F.lit("")))


def is_number(c: Column) -> Column:
    """True where the text is a number once thousands commas are deleted."""
    return F.coalesce(_without_commas(c).rlike(_NUMBER), F.lit(False))


def to_number(c: Column) -> Column:
    """Number after thousands commas are deleted."""
    return strict_double(_without_commas(c))


def currency_code(c: Column, mode: str = "detect") -> Column:
    """ISO code of the currency whose mark the text holds, the first in listing order if there are several.

    ``detect`` names the real currency; ``compat`` gives ``KRW`` for any mark.
    """
    if mode == "compat":
        return F.when(has_currency(c), F.lit("KRW"))
    code = F.lit(None).cast("string")
    for iso, marks in reversed(CURRENCY_MARKS.items()):
        code = F.when(_contains_any(c, marks), F.lit(iso)).otherwise(code)
    return code
