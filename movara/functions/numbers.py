"""Locale-aware number parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from movara.functions.columns import as_col, first_match, let
from movara.functions.text import trim_all

PLAIN_NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def number_text(value, strict: bool = False) -> Column:
    """Money-like text rewritten with a plain decimal point.

    Everything but digits, comma, dot and minus is dropped; with both marks the
    last one is the decimal; a lone mark that groups by three is a thousands mark.
    ``strict`` refuses cells that contain letters other than a currency prefix.
    """
    text = trim_all(value)
    bare = F.regexp_replace(text, r"[^\d,.\-]", "")
    signed = F.when(text.startswith("(") & text.endswith(")"), F.concat(F.lit("-"), bare)).otherwise(bare)
    plain = let(signed, _decimal_point)
    if strict:
        return F.when(~text.rlike(r"(?i)^\(?\s*(?:[a-z]{1,3}\$|us\$|eur|brl|usd)?+.*[a-z]"), plain)
    return plain


def _decimal_point(text: Column) -> Column:
    comma, dot = text.contains(","), text.contains(".")
    no_comma = F.replace(text, F.lit(","), F.lit(""))
    comma_as_point = F.replace(text, F.lit(","), F.lit("."))
    no_dot = F.replace(text, F.lit("."), F.lit(""))
    return first_match(
        (text.isin("", "-", ".", ","), None),
        (comma & dot & text.rlike(r",[^.]*$"), F.replace(no_dot, F.lit(","), F.lit("."))),
        (comma & dot, no_comma),
        (comma & text.rlike(r"^-?\d{1,3}(,\d{3})+$"), no_comma),
        (comma, comma_as_point),
        (text.rlike(r"^-?\d{1,3}(\.\d{3})+$"), no_dot),
        default=text,
    )


def parse_number(value, strict: bool = False) -> Column:
    checked = lambda text: F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    return let(number_text(value, strict), checked)


def looks_numeric(value) -> Column:
    value = as_col(value)
    return F.coalesce(value.rlike(r"\d") & number_text(value).rlike(PLAIN_NUMBER), F.lit(False))


def format_ptbr(value, compact: bool = False) -> Column:
    """Brazilian rendering: dot for thousands, comma for decimals, whole numbers bare."""
    number = as_col(value).cast("double")
    swap = lambda text: F.translate(text, ",.", ".,")
    whole = swap(F.format_number(number, 0))
    cases = [(number == F.floor(number), whole)]
    if compact:
        cases.insert(0, (F.abs(number) >= 1000, whole))
    return first_match((number.isNull(), None), *cases, default=swap(F.format_number(number, 2)))
