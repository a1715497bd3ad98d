"""Rankings, totals and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import as_col, long_form, round_to
from movara.functions.text import folded as without_accents
from movara.functions.text import normalize


def named_groups(df: DataFrame, group: str, folded: bool, total: Column) -> DataFrame:
    """``name`` and a total of each group; ``folded`` takes spellings together under the first of them."""
    text = F.col(group).cast("string")
    if not folded:
        return df.groupBy(text.alias("name")).agg(total)
    return df.groupBy(without_accents(group).alias("_folded")).agg(F.min(text).alias("name"), total).drop("_folded")


def rank_by_sum(df: DataFrame, group: str, metric: str, limit: int = 5, ascending: bool = False, folded: bool = False) -> DataFrame:
    """Top groups by total; rows without a group or a metric are left out. Ties go to the name."""
    valid = df.where(F.col(group).isNotNull() & F.col(metric).isNotNull())
    totals = named_groups(valid, group, folded, F.sum(metric).cast("double").alias("total"))
    order = F.asc("total") if ascending else F.desc("total")
    return totals.orderBy(order, "name").limit(limit)


def rank_by_count(df: DataFrame, group: str, limit: int = 5, ascending: bool = False, folded: bool = False) -> DataFrame:
    named, total = df.where(F.col(group).isNotNull()), F.count("*")
    if folded:  # each spelling is folded once, not in every row
        named, total = named.groupBy(F.col(group).cast("string").alias(group)).agg(total.alias("_copies")), F.sum("_copies")
    counts = named_groups(named, group, folded, total.alias("records"))
    order = F.asc("records") if ascending else F.desc("records")
    return counts.orderBy(order, "name").limit(limit)


def rank_by_mean(df: DataFrame, group: str, metric: str, limit: int = 8) -> DataFrame:
    """Top groups by the (rounded) mean of a rate-like measure."""
    valid = df.where(F.col(group).isNotNull() & F.col(metric).isNotNull())
    means = valid.groupBy(F.col(group).cast("string").alias("name")).agg(round_to(F.avg(metric), 6).alias("mean"))
    return means.orderBy(F.desc("mean"), "name").limit(limit)


def with_position(top: DataFrame, *order: Column) -> DataFrame:
    """Position and share inside an already limited ranking (a handful of rows)."""
    shown = F.sum(F.abs("total")).over(Window.partitionBy())
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("position"),
        "name",
        "total",
        F.try_divide(F.abs("total"), shown).alias("share"),
    )


def rank_with_share(df: DataFrame, group: str, metric: str, limit: int = 8) -> DataFrame:
    return with_position(rank_by_sum(df, group, metric, limit), F.desc("total"), F.asc("name"))


def bars_by_size(totals: DataFrame, limit: int = 10) -> DataFrame:
    """Chart bars: the largest values by magnitude."""
    return totals.orderBy(F.abs("total").desc(), "name").limit(limit)


def pie_slices(totals: DataFrame, limit: int = 8) -> DataFrame:
    """Largest slices with their share of the positive part shown."""
    top = totals.orderBy(F.desc("total"), "name").limit(limit)
    positive = F.greatest(F.col("total"), F.lit(0.0))
    return top.select("name", "total", F.try_divide(positive, F.sum(positive).over(Window.partitionBy())).alias("share"))


def totals_by(df: DataFrame, group: str, metric: str) -> DataFrame:
    valid = df.where(F.col(group).isNotNull() & F.col(metric).isNotNull())
    return valid.groupBy(F.col(group).cast("string").alias("name")).agg(F.sum(metric).cast("double").alias("total"))


def facet_counts(df: DataFrame, dimensions: list[str], limit: int = 10) -> DataFrame:
    """Most frequent values of each dimension.

    Counts are aggregated first; the per-dimension ranking then keeps a bounded
    number of rows on each side of its shuffle.
    """
    long = long_form(df, [], dimensions, "dimension", "name", "string").where(F.col("name").isNotNull())
    counts = long.groupBy("dimension", "name").agg(F.count("*").alias("records"))
    ranked = Window.partitionBy("dimension").orderBy(F.desc("records"), "name")
    return counts.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= limit)


def metric_totals(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(
        F.sum(metric).cast("double").alias("total"),
        (F.sum(metric).cast("double") / F.nullif(F.count(metric), F.lit(0))).alias("mean"),
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values per column.

    Values are collapsed before they are counted, so no task holds a whole column's set.
    """
    long = long_form(df, [], columns, "column", "value", "string").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("distinct_values"))


def first_by_text(df: DataFrame, text: str, *order: str) -> DataFrame:
    """Keep the first row of each normalised text; empty texts are dropped.

    An aggregate, not a window: repeated lines collapse before the shuffle.
    """
    keyed = df.withColumn("_key", normalize(text)).where(F.trim(as_col(text)) != "")
    first = F.min_by(F.struct(*order, text), F.struct(*order))
    return keyed.groupBy("_key").agg(first.alias("kept")).select("kept.*")
