"""Dashboard frames: KPI strip, charts under filters, alerts, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movara.functions.columns import first_match, ratio, round_to, stacked
from movara.functions.labels import score_tone
from movara.functions.sharing import shared
from movara.operators import periods, quality, rank, stats


def preview(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """First rows under an explicit order; the count is clamped to 1..50."""
    return df.orderBy(*order).limit(min(max(rows, 1), 50))


def chart_alerts(bars: DataFrame, series: DataFrame) -> DataFrame:
    """Concentration of the shown values, else a strong last move of the month line."""
    share = F.try_divide(F.max(F.abs("total")), F.sum(F.abs("total")))
    ranking = bars.agg(share.alias("top_share")).select(
        F.lit("ranking").alias("chart"), "top_share", F.lit(None).cast("double").alias("last_move")
    )
    moved = periods.with_movement(series)
    line = moved.agg(
        F.try_divide(F.max(F.abs("value")), F.sum(F.abs("value"))).alias("top_share"),
        F.max_by(ratio("delta", "prev_value"), "period").alias("last_move"),
    ).select(F.lit("monthly").alias("chart"), "top_share", "last_move")
    alert = first_match(
        (F.col("top_share") >= 0.8, "high_concentration"),
        (F.abs("last_move") >= 0.5, "strong_movement"),
        default="none",
    )
    return ranking.unionByName(line).select(
        "chart", round_to("top_share").alias("top_share"), round_to("last_move").alias("last_move"), alert.alias("alert")
    )


def kpis(df: DataFrame, metric: str, ts: str, scored: DataFrame) -> DataFrame:
    """KPI strip: rows, metric total and mean, score, duplicates and rate, months and span."""
    totals = df.agg(
        F.count("*").cast("double").alias("rows"),
        F.sum(metric).cast("double").alias("total"),
        F.count(metric).alias("n"),
    )
    names = ("kpi", "value", "detail")
    measured = totals.select(
        stacked(
            names,
            ("rows", F.col("rows"), F.lit(len(df.columns)).cast("double")),
            ("metric", round_to("total", 2), round_to(F.try_divide(F.col("total"), F.col("n")))),
        )
    )
    checked = scored.select(
        stacked(
            names,
            ("score", F.col("score").cast("double"), F.lit(None).cast("double")),
            (
                "duplicates",
                F.col("duplicate_rows").cast("double"),
                round_to(F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1))),
            ),
        ),
        score_tone("score").alias("score_tone"),
    )
    checked = checked.select(
        "kpi",
        "value",
        "detail",
        first_match(
            (F.col("kpi") == "score", F.col("score_tone")), (F.col("value") == 0, "good"), default="warning"
        ).alias("tone"),
        F.lit(None).cast("string").alias("span"),
    )
    span = stats.date_span(df, ts).select(
        F.lit("months").alias("kpi"),
        F.col("months").cast("double").alias("value"),
        F.lit(None).cast("double").alias("detail"),
        F.lit("neutral").alias("tone"),
        F.concat_ws("..", "first_date", "last_date").alias("span"),
    )
    measured = measured.select(
        "kpi",
        "value",
        "detail",
        F.when(F.col("kpi") == "metric", "accent").otherwise("neutral").alias("tone"),
        F.lit(None).cast("string").alias("span"),
    )
    return measured.unionByName(checked).unionByName(span)


def dashboard(
    df: DataFrame,
    condition: Column,
    metric: str,
    period: str,
    dimensions: list[str],
    margin: str | None = None,
    numeric: list[str] | None = None,
) -> DataFrame:
    """Charts of the filtered rows: months, rankings, one margin ranking, quality; at most five."""
    rows = df.where(condition)
    shaped = lambda frame, order, chart, label, value: frame.select(
        F.lit(order).cast("bigint").alias("chart_order"),
        F.lit(chart).alias("chart"),
        F.col(label).alias("label"),
        round_to(value, 4).alias("value"),
    )
    charts = [shaped(periods.monthly_sum(rows, metric, period), 1, "monthly", "period", "value")]
    for dimension in dimensions[:3]:
        ranking = rank.rank_by_sum(rows, dimension, metric, 8)
        charts.append(shaped(ranking, len(charts) + 1, f"ranking_{dimension}", "name", "total"))
        if margin:
            means = rank.rank_by_mean(rows, dimension, margin, 8)
            charts.append(shaped(means, len(charts) + 1, f"margin_{dimension}", "name", "mean"))
            break
    if len(charts) < 5:
        rates = quality.quality_rates(shared(quality.quality_score(rows, numeric)))
        charts.append(shaped(rates, len(charts) + 1, "quality", "indicator", "value"))
    result = charts[0]
    for chart in charts[1:5]:
        result = result.unionByName(chart)
    return result
