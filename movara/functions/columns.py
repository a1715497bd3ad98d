"""Small helpers shared by every column expression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_match(*branches: tuple[Column, object], default=None) -> Column:
    """A CASE chain; plain Python results become literals."""
    chain = None
    for condition, result in branches:
        value = result if isinstance(result, Column) else F.lit(result)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def ratio(delta, base) -> Column:
    """delta / |base|, null for a missing or zero base."""
    return F.try_divide(as_col(delta).cast("double"), F.abs(as_col(base)).cast("double"))


def round_to(value, places: int = 4) -> Column:
    return F.round(as_col(value).cast("double"), places)


def finite(value) -> Column:
    """Numeric value with NaN and infinities read as missing."""
    number = as_col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def safe_text(value, limit: int = 160) -> Column:
    """Report-cell text: the value as a string, cut at the documented cell width."""
    return F.substring(as_col(value).cast("string"), 1, limit)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, keep: Iterable[str], columns: Iterable[str], name: str, value: str, kind: str) -> DataFrame:
    """Wide to long, casting every folded column to one type."""
    keep = list(keep)
    columns = list(columns)
    wide = df.select(*keep, *[F.col(c).cast(kind).alias(c) for c in columns])
    return wide.unpivot(keep, columns, name, value)


def stacked(names: Iterable[str], *rows: tuple) -> Column:
    """``inline`` generator of literal-shaped rows, one struct per tuple."""
    names = list(names)
    as_value = lambda v: v if isinstance(v, Column) else F.lit(v)
    structs = [F.struct(*[as_value(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return F.inline(F.array(*structs))


#: Magnitude below which sums are exact; beyond it a plain double sum is as good.
EXACT_BELOW = 1e28
#: Below this magnitude a value may have a fraction, and its parts are summed as long integers.
LONG_BELOW = 2.0**53


def exact_sum(value, over: WindowSpec | None = None) -> Column:
    """Order-independent sum as a double: the same whatever the partitioning, without a fixed number of decimals.

    Whole parts and fractions (to 60 binary places) are summed apart, each in two halves as long integers, so that neither tiny
    nor huge values lose digits or overflow; only values without a fraction need decimals. ``over`` makes it a window function.
    """
    number = as_col(value).cast("double")
    size = F.abs(number)
    placed = lambda c: c.over(over) if over is not None else c
    near = F.when(size < LONG_BELOW, number)
    whole = F.rint(near)
    fraction = (near - whole) * 2.0**30

    def halves(high: Column, low: Column, step: int) -> Column:
        total = lambda c: F.coalesce(placed(F.try_sum(c.cast("long"))), F.lit(0)).cast("decimal(20,0)")
        return total(high) * F.lit(step).cast("decimal(10,0)") + total(low)

    wholes = halves(F.rint(whole / 2.0**27), whole - F.rint(whole / 2.0**27) * 2.0**27, 2**27)
    fractions = halves(F.rint(fraction), F.rint((fraction - F.rint(fraction)) * 2.0**30), 2**30)
    most = placed(F.max(size))
    far = placed(F.try_sum(F.when(size >= LONG_BELOW, number).try_cast("decimal(38,0)")))
    whole_total = F.when(most < LONG_BELOW, wholes).otherwise(F.try_add(far, wholes))
    exact = whole_total.cast("double") + fractions.cast("double") / 2.0**60
    return F.when(most < EXACT_BELOW, exact).otherwise(placed(F.sum(number)))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN read as missing in the given (else all) floating-point columns."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    chosen = [c for c in floating if not columns or c in columns]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen}) if chosen else df


def let(value, build) -> Column:
    """``build(value)`` with the value evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(as_col(value)), build), F.lit(0))
