"""Report filters: date range, category lists, and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from movara.functions.dates import month_bounds
from movara.functions.text import folded as without_accents


def date_range(column: str, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive range on timestamps; a date-only end means its midnight.

    A bound that does not parse is ignored; rows without a date drop out once a bound holds.
    """
    keep = F.lit(True)
    for bound, compare in ((start, "ge"), (end, "le")):
        if bound is None or not bound.strip():
            continue
        limit = F.lit(bound.strip()).try_cast("timestamp_ntz")
        test = F.col(column) >= limit if compare == "ge" else F.col(column) <= limit
        keep = keep & F.when(limit.isNull(), F.lit(True)).otherwise(test)
    return keep


def categories(df: DataFrame, selected: dict[str, list[str]], folded: bool = False) -> Column:
    """AND over columns of value lists; unknown columns and blank values are ignored.

    ``folded`` compares without accents and capitals.
    """
    keep = F.lit(True)
    for column, values in selected.items():
        chosen = [str(v) for v in values if str(v).strip()]
        if column in df.columns and chosen:
            text = without_accents(column) if folded else F.col(column).cast("string")
            keep = keep & text.isin(*chosen)
    return keep


def filter_report(df: DataFrame, *conditions: Column) -> DataFrame:
    passed = F.lit(True)
    for condition in conditions:
        passed = passed & condition
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.coalesce(passed, F.lit(False))).alias("rows_after"),
        F.lit(len(conditions)).cast("bigint").alias("filters_applied"),
    )


def month_filter(column: str, period: str) -> Column:
    """Drill-down into one month of a chart: its first to its last day (at midnight)."""
    first, last = month_bounds(F.lit(period))
    return F.col(column).between(first.cast("timestamp_ntz"), last.cast("timestamp_ntz"))


def in_listed(df: DataFrame, column: str, listed: DataFrame, folded: bool = False) -> DataFrame:
    """Keep rows whose value appears in a table of selected values; ``folded`` compares without accents and capitals."""
    text = without_accents if folded else lambda c: F.col(c).cast("string")
    values = listed.select(text(listed.columns[0]).alias("_value")).distinct()
    return df.join(values, text(column) == F.col("_value"), "left_semi")


def write_filtered(df: DataFrame, folder: str, *conditions: Column) -> dict[str, int]:
    """The rows that pass all conditions as a Parquet table; the figures of ``filter_report`` come from the same pass."""
    passed = F.lit(True)
    for condition in conditions:
        passed = passed & condition
    before, after = Observation("before"), Observation("after")
    rows = F.count("*").alias("rows")
    df.observe(before, rows).where(passed).observe(after, rows).write.parquet(folder)
    return {"rows_before": before.get["rows"], "rows_after": after.get["rows"], "filters_applied": len(conditions)}
