"""Month series: movements, running history, comparisons.

Every frame here is one row per observed month, so windows without a partition
only ever see the months of the series (a missing month is skipped, not filled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import exact_sum, first_match, ratio, round_to, stacked
from movara.functions.dates import period_month, period_year
from movara.functions.labels import movement_status, sign_tone, status_tone
from movara.sources.mart import AnalysisSpec


def by_period():
    return Window.orderBy("period")


def latest_first():
    return Window.orderBy(F.desc("period"))


def period_metrics(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """One row per month: the summed metric plus its supporting measures."""
    valid = df.where(F.col(spec.period).isNotNull() & F.col(spec.metric).isNotNull())
    aggregates = [F.sum(spec.metric).cast("double").alias("value")]
    for name, (column, how) in spec.supports.items():
        if how == "sum":
            aggregates.append(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias(name))
        else:
            aggregates.append(F.avg(column).cast("double").alias(name))
    return valid.groupBy(F.col(spec.period).alias("period")).agg(*aggregates)


def monthly_sum(df: DataFrame, metric: str, period: str = "period") -> DataFrame:
    return period_metrics(df, AnalysisSpec(metric=metric, period=period, supports={}))


def with_movement(series: DataFrame) -> DataFrame:
    """Change against the previous observed month; pct is against the signed previous value."""
    previous = F.lag("value").over(by_period())
    return (
        series.withColumn("prev_period", F.lag("period").over(by_period()))
        .withColumn("prev_value", previous)
        .withColumn("delta", F.col("value") - F.col("prev_value"))
        .withColumn("pct", F.try_divide("delta", "prev_value"))
    )


def with_history(series: DataFrame) -> DataFrame:
    """Mean, sample deviation and z-score against all earlier months."""
    earlier = by_period().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count("value").over(earlier)
    mean = F.when(seen >= 2, exact_sum("value", earlier) / seen)
    std = F.when(seen >= 3, F.stddev_samp("value").over(earlier))
    return (
        series.withColumn("hist_mean", mean)
        .withColumn("hist_std", std)
        .withColumn("zscore", F.try_divide(F.col("value") - F.col("hist_mean"), F.col("hist_std")))
    )


def movements(series: DataFrame) -> DataFrame:
    return with_history(with_movement(series))


def with_moving_average(series: DataFrame, rows: int = 3) -> DataFrame:
    frame = by_period().rowsBetween(1 - rows, 0)
    mean = exact_sum("value", frame) / F.count("value").over(frame)
    return series.withColumn("moving_avg", mean)


def with_year_to_date(series: DataFrame) -> DataFrame:
    frame = Window.partitionBy("year").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("year", period_year("period")).withColumn("ytd", F.sum("value").over(frame))


def last_periods(series: DataFrame, count: int) -> DataFrame:
    """The latest ``count`` observed months."""
    return series.withColumn("_age", F.row_number().over(latest_first())).where(F.col("_age") <= count).drop("_age")


def monthly_comparison(series: DataFrame) -> DataFrame:
    moved = movements(series)
    status = movement_status("delta", "pct", "zscore")
    return moved.withColumn("status", status).withColumn("tone", status_tone("status"))


def movement_table(series: DataFrame) -> DataFrame:
    """The published comparison: rounded figures and the status of each month."""
    figures = ["value", "prev_value", "delta", "pct", "hist_mean", "hist_std", "zscore"]
    return monthly_comparison(series).select("period", *[round_to(c).alias(c) for c in figures], "status", "tone")


def focus_movement(moved: DataFrame) -> DataFrame:
    """The largest absolute change; a drop wins over an equal rise, then the earlier month."""
    return (
        moved.where(F.col("delta").isNotNull())
        .orderBy(F.abs("delta").desc(), F.col("delta"), "period")
        .limit(1)
    )


def latest_movement(moved: DataFrame) -> DataFrame:
    return moved.where(F.col("delta").isNotNull()).orderBy(F.desc("period")).limit(1)


def extreme_movements(moved: DataFrame) -> DataFrame:
    """One row: the months of the latest, largest rise and largest drop movements."""
    rows = moved.where(F.col("delta").isNotNull())
    entry = F.struct("period", "value", "delta", "pct")
    return rows.agg(
        F.max_by(entry, F.col("period")).alias("latest"),
        F.min_by(entry, F.struct(-F.col("delta"), F.col("period"))).alias("rise"),
        F.min_by(entry, F.struct(F.col("delta"), F.col("period"))).alias("drop"),
    )


def abnormal_periods(moved: DataFrame) -> DataFrame:
    """Months whose relative change or z-score stands out."""
    rows = moved.where(F.col("delta").isNotNull())
    cut = rows.agg(F.greatest(F.percentile(F.abs("pct"), F.lit(0.8)), F.lit(0.25)).alias("cut"))
    threshold = F.coalesce(cut.scalar(), F.lit(0.25))
    return rows.withColumn("threshold", threshold).where(
        (F.abs("pct") >= F.col("threshold")) | (F.coalesce(F.abs("zscore"), F.lit(0.0)) >= 2)
    )


def best_worst(series: DataFrame) -> DataFrame:
    entry = F.struct("period", "value")
    return series.agg(
        F.min_by(entry, F.struct(-F.col("value"), F.col("period"))).alias("best"),
        F.min_by(entry, F.struct(F.col("value"), F.col("period"))).alias("worst"),
    ).select(
        F.col("best.period").alias("best_period"),
        F.col("best.value").alias("best_value"),
        F.col("worst.period").alias("worst_period"),
        F.col("worst.value").alias("worst_value"),
    )


def last_three_months(series: DataFrame) -> DataFrame:
    """Sum of the last three observed months against the three before them."""
    aged = series.withColumn("age", F.row_number().over(latest_first())).where(F.col("age") <= 6)
    totals = aged.agg(
        F.sum(F.when(F.col("age") <= 3, F.col("value"))).alias("last3"),
        F.coalesce(F.sum(F.when(F.col("age") > 3, F.col("value"))), F.lit(0.0)).alias("prev3"),
        F.try_divide(
            exact_sum(F.when(F.col("age") <= 3, F.col("value"))), F.count_if(F.col("age") <= 3)
        ).alias("avg3"),
        F.max(F.when(F.col("age") == 1, F.col("value"))).alias("latest_value"),
    )
    return totals.withColumn("delta", F.col("last3") - F.col("prev3")).withColumn("pct", ratio("delta", "prev3"))


def year_to_date_comparison(series: DataFrame) -> DataFrame:
    """Latest year to date against the same months of the year before (null when absent)."""
    parts = series.select("value", period_year("period").alias("y"), period_month("period").alias("m"), "period")
    latest = F.max("period").over(Window.partitionBy())
    aged = parts.withColumn("ly", period_year(latest)).withColumn("lm", period_month(latest))
    within = F.col("m") <= F.col("lm")
    totals = aged.agg(
        F.max("period").alias("latest_period"),
        F.sum(F.when((F.col("y") == F.col("ly")) & within, F.col("value"))).alias("ytd"),
        F.sum(F.when((F.col("y") == F.col("ly") - 1) & within, F.col("value"))).alias("prev_ytd"),
    )
    return totals.withColumn("delta", F.col("ytd") - F.col("prev_ytd")).withColumn("pct", ratio("delta", "prev_ytd"))


def support_changes(series: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Per month and supporting measure: previous value, change and relative change."""
    names = list(spec.supports)
    by_driver = Window.partitionBy("driver").orderBy("period")
    long = series.unpivot(["period"], names, "driver", "current_value")
    return (
        long.withColumn("previous_value", F.lag("current_value").over(by_driver))
        .withColumn("delta", F.col("current_value") - F.col("previous_value"))
        .withColumn("pct", ratio("delta", "previous_value"))
    )


def monthly_drivers(series: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Supporting measures ranked inside each month; rank 1 is the main driver.

    Ranking uses the published four-decimal figures; the first named measure wins ties.
    """
    order = first_match(*[(F.col("driver") == name, i) for i, name in enumerate(spec.supports)])
    changes = support_changes(series, spec).where(F.col("delta").isNotNull())
    figures = ["current_value", "previous_value", "delta", "pct"]
    rounded = changes.select("period", "driver", *[round_to(c).alias(c) for c in figures])
    weight = F.greatest(F.abs(F.coalesce("pct", F.lit(0.0))), F.abs("delta") / 1000)
    ranked = Window.partitionBy("period").orderBy(weight.desc(), order)
    return rounded.withColumn("position", F.row_number().over(ranked))


def safe_corr(left: str, right: str) -> Column:
    """Pearson correlation over complete pairs; null below three pairs or for a constant side."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    a, b = F.when(both, F.col(left)), F.when(both, F.col(right))
    value = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    varied = (F.max(a) != F.min(a)) & (F.max(b) != F.min(b))
    return F.round(F.when((F.count(a) >= 3) & varied, value), 3)


def driver_correlation(series: DataFrame, spec: AnalysisSpec) -> DataFrame:
    long = series.unpivot(["period", "value"], list(spec.supports), "driver", "support")
    return long.groupBy("driver").agg(safe_corr("value", "support").alias("correlation"))


def driver_evidence(series: DataFrame, spec: AnalysisSpec, focus: DataFrame) -> DataFrame:
    """Supporting measures in the focus month with their correlation to the metric."""
    at_focus = support_changes(series, spec).join(focus.select("period"), "period", "left_semi")
    return at_focus.join(driver_correlation(series, spec), "driver", "left").select(
        "driver",
        *[round_to(c).alias(c) for c in ("current_value", "previous_value", "delta")],
        "correlation",
    )


def trend(series: DataFrame, months: int = 6) -> DataFrame:
    tail = last_periods(series, months)
    ends = tail.agg(
        F.min_by("value", "period").alias("start_value"),
        F.max_by("value", "period").alias("end_value"),
        F.min("period").alias("start_period"),
        F.max("period").alias("end_period"),
        F.count("*").alias("months"),
    )
    change = F.col("end_value") - F.col("start_value")
    return ends.select(
        "start_period",
        "end_period",
        "months",
        F.when(F.col("months") >= 2, round_to(change)).alias("change"),
        F.when(F.col("months") >= 2, round_to(ratio(change, "start_value"))).alias("change_pct"),
        first_match(
            (F.col("months") < 2, "undefined"), (change > 0, "up"), (change < 0, "down"), default="flat"
        ).alias("direction"),
    )


def year_over_year(series: DataFrame) -> DataFrame:
    """Each month next to the same month one year earlier."""
    now = series.select(
        "period", "value", period_year("period").alias("year"), period_month("period").alias("month")
    )
    before = now.select(
        (F.col("year") + 1).alias("year"), "month", F.col("value").alias("previous_year_value")
    )
    return (
        now.join(before, ["year", "month"], "left")
        .withColumn("delta", F.col("value") - F.col("previous_year_value"))
        .withColumn("pct", ratio("delta", "previous_year_value"))
    )


def period_slice(series: DataFrame, year: int, first_month: int, last_month: int) -> DataFrame:
    low, high = sorted((first_month, last_month))
    return series.where((period_year("period") == year) & period_month("period").between(low, high))


def slice_summary(series: DataFrame, year: int, first_month: int, last_month: int) -> DataFrame:
    """Totals, extremes and the previous-year comparison of one slice of months."""
    moved = with_movement(series).join(
        year_over_year(series).select("period", "previous_year_value"), "period", "left"
    )
    rows = period_slice(moved, year, first_month, last_month)
    value_desc = F.struct(-F.col("value"), F.col("period"))
    delta_rows = F.col("delta").isNotNull()
    summary = rows.agg(
        F.sum("value").alias("total"),
        F.try_divide(exact_sum("value"), F.count("value")).alias("monthly_mean"),
        F.min_by("period", value_desc).alias("best_period"),
        F.min_by("period", F.struct("value", "period")).alias("worst_period"),
        F.min_by("period", F.when(delta_rows, F.struct(-F.col("delta"), F.col("period")))).alias("rise_period"),
        F.min_by("period", F.when(delta_rows, F.struct("delta", "period"))).alias("drop_period"),
        F.sum("previous_year_value").alias("previous_year_total"),
    )
    return summary.withColumn("delta", F.col("total") - F.col("previous_year_total")).withColumn(
        "pct", ratio("delta", "previous_year_total")
    )


def comparative_cards(series: DataFrame) -> DataFrame:
    """Five cards: last three months, year to date, moving average, best and worst month."""
    quarter = last_three_months(series)
    ytd = year_to_date_comparison(series)
    extremes = best_worst(series)
    gap = F.col("latest_value") - F.col("avg3")

    def card(df: DataFrame, order: int, name: str, value, delta, pct, period, tone) -> DataFrame:
        return df.select(
            F.lit(order).cast("bigint").alias("position"),
            F.lit(name).alias("card"),
            round_to(value, 2).alias("value"),
            round_to(delta, 2).alias("delta"),
            round_to(pct).alias("pct"),
            period.cast("string").alias("period"),
            tone.alias("tone"),
        )

    none = F.lit(None)
    cards = [
        card(quarter, 1, "last_3_months", "last3", "delta", "pct", none, sign_tone("delta")),
        card(ytd, 2, "year_to_date", "ytd", "delta", "pct", F.col("latest_period"), sign_tone("delta")),
        card(quarter, 3, "moving_average_3", "avg3", gap, ratio(gap, "avg3"), none, sign_tone(gap)),
        card(extremes, 4, "best_month", "best_value", none, none, F.col("best_period"), F.lit("good")),
        card(extremes, 5, "worst_month", "worst_value", none, none, F.col("worst_period"), F.lit("warning")),
    ]
    result = cards[0]
    for other in cards[1:]:
        result = result.unionByName(other)
    return result


def movement_kpis(moved: DataFrame) -> DataFrame:
    """KPI rows of the movement analysis."""
    none = F.lit(None).cast("double")
    field = lambda row, name: F.col(f"{row}.{name}")
    ends = extreme_movements(moved).select(
        stacked(
            ("kpi", "label", "amount", "pct"),
            ("latest_period", field("latest", "period"), field("latest", "value"), none),
            ("latest_change", field("latest", "period"), field("latest", "delta"), field("latest", "pct")),
            ("largest_rise", field("rise", "period"), field("rise", "delta"), none),
            ("largest_drop", field("drop", "period"), field("drop", "delta"), none),
        )
    )
    span = moved.agg(
        F.lit("periods").alias("kpi"),
        F.concat_ws("..", F.min("period"), F.max("period")).alias("label"),
        F.count("*").cast("double").alias("amount"),
        F.lit(None).cast("double").alias("pct"),
    )
    rows = ends.unionByName(span)
    return rows.select("kpi", "label", round_to("amount", 2).alias("amount"), round_to("pct").alias("pct"))


def point_moves(series: DataFrame) -> DataFrame:
    """Per shown point: change against the previous point, strong-move flag, share of the shown total."""
    moved = with_movement(series).withColumn("abs_pct", ratio("delta", "prev_value"))
    total = F.sum(F.abs("value")).over(Window.partitionBy())
    strong = F.coalesce(F.abs("abs_pct") >= 0.5, F.lit(False))
    return moved.select(
        "period",
        "value",
        "prev_value",
        "delta",
        F.col("abs_pct").alias("pct"),
        strong.cast("int").alias("strong_move"),
        first_match((strong & (F.col("delta") < 0), "warning"), (strong, "good"), default="neutral").alias("severity"),
        F.try_divide(F.abs("value"), total).alias("share"),
    )
