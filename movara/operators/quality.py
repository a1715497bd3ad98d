"""Data quality: missing cells, duplicates, empty columns, outliers, score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import exact_sum, first_match, long_form, nan_to_null, numeric_columns, round_to, stacked
from movara.functions.sharing import shared
from movara.functions.labels import quality_label
from movara.operators.stats import duplicate_rows, missing_summary, per_column, quantile_table

# How many points each defect can cost.
PENALTIES = {"missing": 45.0, "duplicates": 25.0, "empty_columns": 20.0, "outliers": 10.0}


def _bounds_map(bounds: DataFrame, fields: Iterable[str]) -> Column:
    """All columns' bounds as one scalar map, so the facts are read without a join."""
    entry = F.struct("column", F.struct(*fields))
    return bounds.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def outlier_bounds(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Bounds and outlier counts per numeric column.

    Interquartile bounds first; a column without any such outlier falls back to five
    times or a fifth of its median. Columns with no interquartile spread are skipped.
    """
    columns = list(columns or numeric_columns(df))
    df = nan_to_null(df, *columns)
    quartiles = shared(quantile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    spread = F.col("q3") - F.col("q1")
    bounds = quartiles.where(spread != 0).select(
        "column",
        "median",
        (F.col("q1") - 1.5 * spread).alias("low"),
        (F.col("q3") + 1.5 * spread).alias("high"),
        F.least(F.col("median") * 5, F.col("median") / 5).alias("low5"),
        F.greatest(F.col("median") * 5, F.col("median") / 5).alias("high5"),
    )
    lookup = _bounds_map(bounds, ["low", "high", "low5", "high5"])
    rows = df.withColumn("_bounds", lookup)

    def measures(c: str) -> dict[str, Column]:
        v, b = F.col(c).cast("double"), F.col("_bounds")[c]
        return {
            "n": F.count(v),
            "mean": F.try_divide(exact_sum(c), F.count(v)),
            "iqr_count": F.count_if((v < b["low"]) | (v > b["high"])),
            "ratio_count": F.count_if((v < b["low5"]) | (v > b["high5"])),
        }

    counted = per_column(rows, columns, measures).join(bounds, "column")
    by_ratio = F.col("iqr_count") == 0
    usable = (F.col("n") >= 3) & (F.col("median") != 0)
    return counted.select(
        "column",
        "n",
        "mean",
        "median",
        F.when(by_ratio, "ratio").otherwise("iqr").alias("rule"),
        F.when(by_ratio & usable, F.col("low5")).otherwise(F.col("low")).alias("low"),
        F.when(by_ratio & usable, F.col("high5")).otherwise(F.col("high")).alias("high"),
        first_match((~by_ratio, F.col("iqr_count")), (usable, F.col("ratio_count")), default=F.lit(0).cast("bigint")).alias(
            "outliers"
        ),
    )


def outlier_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return outlier_bounds(df, columns).where(F.col("outliers") > 0)


def outlier_details(
    df: DataFrame, key: str, columns: Iterable[str] | None = None, per_col: int = 3, limit: int = 12
) -> DataFrame:
    """The strongest outliers per column, then overall, identified by the caller's row key."""
    columns = list(columns or numeric_columns(df))
    df = nan_to_null(df, *columns)
    bounds = shared(outlier_counts(df, columns))
    lookup = _bounds_map(bounds, ["low", "high"])
    outside = lambda c: (F.col(c) < F.col("_b")[c]["low"]) | (F.col(c) > F.col("_b")[c]["high"])
    flagged = df.select(F.col(key).alias("row_key"), *[F.col(c).cast("double").alias(c) for c in columns])
    flagged = flagged.withColumn("_b", lookup).select(
        "row_key", *[F.when(outside(c), F.col(c)).alias(c) for c in columns]
    )
    long = long_form(flagged, ["row_key"], columns, "column", "value", "double").where(F.col("value").isNotNull())
    joined = long.join(bounds, "column")
    farthest = Window.partitionBy("column").orderBy(
        F.desc("distance"), F.desc("value"), F.asc("row_key")
    )
    top = (
        joined.withColumn("distance", F.abs(F.col("value") - F.col("median")))
        .withColumn("position", F.row_number().over(farthest))
        .where(F.col("position") <= per_col)
    )
    base = F.when(F.col("mean") != 0, F.abs("mean")).otherwise(F.greatest(F.abs("median"), F.lit(1.0)))
    detailed = top.select(
        "column",
        "row_key",
        F.col("position").cast("bigint").alias("position"),
        round_to("value").alias("value"),
        round_to("mean").alias("mean"),
        round_to(F.abs(F.col("value") - F.col("mean")) / base, 2).alias("deviation"),
        round_to("low").alias("low"),
        round_to("high").alias("high"),
    )
    return detailed.orderBy(F.desc("deviation"), "column", "position").limit(limit)


def quality_score(df: DataFrame, numeric: Iterable[str] | None = None) -> DataFrame:
    """One row: counts, lost points per defect, and the whole score out of 100."""
    missing = missing_summary(df)
    duplicates = duplicate_rows(df).scalar()
    outliers = outlier_counts(df, numeric).agg(F.coalesce(F.sum("outliers"), F.lit(0)).cast("bigint")).scalar()
    rows = df.agg(F.count("*")).scalar()
    counted = missing.select(
        rows.alias("rows"),
        "columns",
        "missing_total",
        duplicates.alias("duplicate_rows"),
        "empty_columns",
        outliers.alias("outliers"),
    )
    at_least_one = lambda c: F.greatest(c, F.lit(1))

    def lost(kind: str, count: str, base: Column) -> Column:
        points = PENALTIES[kind]
        return F.round(F.least(F.lit(points), F.col(count) / base * points), 2)

    return counted.select(
        "*",
        lost("missing", "missing_total", at_least_one(F.col("rows") * F.col("columns"))).alias("missing_points"),
        lost("duplicates", "duplicate_rows", at_least_one(F.col("rows"))).alias("duplicate_points"),
        lost("empty_columns", "empty_columns", at_least_one(F.col("columns"))).alias("empty_points"),
        lost("outliers", "outliers", at_least_one(F.col("rows"))).alias("outlier_points"),
    ).withColumn(
        "score",
        F.greatest(
            F.lit(0),
            F.bround(
                100
                - (F.col("missing_points") + F.col("duplicate_points") + F.col("empty_points") + F.col("outlier_points"))
            ),
        ).cast("bigint"),
    )


def quality_rates(scored: DataFrame) -> DataFrame:
    """The quality chart: score and defect percentages."""
    rate = lambda count, base: F.round(F.col(count) / F.greatest(base, F.lit(1)) * 100, 2)
    shown = stacked(
        ("indicator", "value"),
        ("quality", F.col("score").cast("double")),
        ("missing_pct", rate("missing_total", F.col("rows") * F.col("columns"))),
        ("duplicate_pct", rate("duplicate_rows", F.col("rows"))),
        ("outlier_pct", rate("outliers", F.col("rows"))),
    )
    return scored.select(shown, quality_label("score").alias("label"))
