"""Why a month moved: contribution by dimension, history, recurrence, waterfall.

The heavy work is one aggregate of the facts to (dimension, name, period). All later
frames are one row per entity or smaller. Totals over a dimension are aggregates joined
back on the dimension, and top-k rankings are plain row-number filters, which Spark
prunes on both sides of the shuffle, so no task ever holds all entities of a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import exact_sum, first_match, long_form, ratio, round_to, stacked
from movara.functions.labels import concentration_level, direction
from movara.functions.sharing import shared
from movara.operators.periods import abnormal_periods, focus_movement, movements, period_metrics
from movara.sources.mart import AnalysisSpec

ROUNDED = (
    "current_value",
    "previous_value",
    "delta",
    "pct",
    "share_abs",
    "share_total",
    "hist_mean",
    "hist_delta",
)


def entity_periods(df: DataFrame, spec: AnalysisSpec, dimensions=None) -> DataFrame:
    """Metric per (dimension, name, period); missing names never form a group."""
    dims = list(dimensions or spec.dimensions)
    valid = df.where(F.col(spec.period).isNotNull() & F.col(spec.metric).isNotNull())
    long = long_form(valid, [spec.period, spec.metric], dims, "dimension", "name", "string")
    return (
        long.where(F.col("name").isNotNull())
        .groupBy("dimension", "name", F.col(spec.period).alias("period"))
        .agg(F.sum(spec.metric).cast("double").alias("value"))
    )


def period_slots(series: DataFrame, focus: DataFrame, slots: int = 4) -> DataFrame:
    """The focus month (slot 0) and the observed months before it."""
    focus_period = focus.select("period").scalar()
    newest = Window.orderBy(F.desc("period"))
    upto = series.select("period").where(F.col("period") <= focus_period)
    return upto.select("period", (F.row_number().over(newest) - 1).alias("slot")).where(F.col("slot") < slots)


def slot_sum(slot: int) -> Column:
    return F.sum(F.when(F.col("slot") == slot, F.col("value")))


def entity_movements(entities: DataFrame, slots: DataFrame) -> DataFrame:
    """One row per entity: the values of the four slots and the mean over all its months.

    Missing slots count as zero, which equals the zero-filled entity-by-period grid
    cut to the months that the recurrence rule looks at.
    """
    placed = entities.join(slots, "period", "left")
    return placed.groupBy("dimension", "name").agg(
        *[F.coalesce(slot_sum(i), F.lit(0.0)).alias(f"v{i}") for i in range(4)],
        (exact_sum("value") / F.count("value")).alias("hist_mean"),
        F.count_if(F.col("slot") <= 1).alias("observed"),
    )


def contributions(moves: DataFrame) -> DataFrame:
    """Entities present in the focus or the previous month, with their change."""
    return moves.where(F.col("observed") > 0).select(
        "dimension",
        "name",
        F.col("v0").alias("current_value"),
        F.col("v1").alias("previous_value"),
        (F.col("v0") - F.col("v1")).alias("delta"),
        "hist_mean",
    )


def dimension_totals(contributed: DataFrame) -> DataFrame:
    """Change totals per dimension; a dimension with one entity or no change explains nothing."""
    totals = contributed.groupBy("dimension").agg(
        F.count("*").alias("entities"), F.sum(F.abs("delta")).alias("abs_total")
    )
    return totals.where((F.col("entities") >= 2) & (F.col("abs_total") > 0))


def ranked_contributors(contributed: DataFrame, limit: int = 8) -> DataFrame:
    by_size = Window.partitionBy("dimension").orderBy(F.abs("delta").desc(), "name")
    return contributed.withColumn("position", F.row_number().over(by_size)).where(F.col("position") <= limit)


def recurrence(moves: DataFrame, slots: DataFrame, top: int = 3, minimum: int = 2) -> DataFrame:
    """Entities among the three largest changes in at least two of the last three months.

    A month with no month before it has no change, so only slots with a predecessor count.
    """
    counted = slots.agg(F.count("*")).scalar()
    changes = moves.select(
        "dimension",
        "name",
        F.abs(F.col("v0") - F.col("v1")).alias("0"),
        F.abs(F.col("v1") - F.col("v2")).alias("1"),
        F.abs(F.col("v2") - F.col("v3")).alias("2"),
    ).unpivot(["dimension", "name"], ["0", "1", "2"], "slot", "size")
    largest = Window.partitionBy("dimension", "slot").orderBy(F.desc("size"), "name")
    kept = changes.withColumn("position", F.row_number().over(largest)).where(F.col("position") <= top)
    kept = kept.where(F.col("slot").cast("int") + 1 < counted)
    return (
        kept.groupBy("dimension", "name")
        .agg(F.count("*").alias("appearances"))
        .where(F.col("appearances") >= minimum)
    )


def contributors(df: DataFrame, spec: AnalysisSpec, limit: int = 8, series: DataFrame | None = None) -> DataFrame:
    """Top contributors of every dimension to the focus movement, with shares, history and recurrence."""
    if series is None:
        series = shared(period_metrics(df, AnalysisSpec(metric=spec.metric, period=spec.period, supports={})))
    focus = focus_movement(movements(series))
    slots = period_slots(series, focus)
    moves = shared(entity_movements(entity_periods(df, spec), slots))
    contributed = contributions(moves)
    totals = dimension_totals(contributed)
    recurrent = recurrence(moves, slots)
    total_delta = focus.select("delta").scalar()
    joined = (
        ranked_contributors(contributed, limit)
        .join(totals, "dimension")
        .join(recurrent, ["dimension", "name"], "left")
    )
    share = F.try_divide(F.abs("delta"), F.col("abs_total"))
    detailed = joined.select(
        "dimension",
        "name",
        F.col("position").cast("bigint").alias("position"),
        "current_value",
        "previous_value",
        "delta",
        ratio("delta", "previous_value").alias("pct"),
        share.alias("share_abs"),
        F.try_divide(F.col("delta"), total_delta).alias("share_total"),
        "hist_mean",
        (F.col("current_value") - F.col("hist_mean")).alias("hist_delta"),
        concentration_level(share).alias("concentration"),
        F.when(F.col("appearances").isNotNull(), "recurrent").otherwise("one_off").alias("recurrence"),
    )
    rounded = [round_to(c).alias(c) if c in ROUNDED else F.col(c) for c in detailed.columns]
    return shared(detailed.select(*rounded))


def impact_ranking(top: DataFrame, per_dimension: int = 5, limit: int = 12) -> DataFrame:
    """The strongest contributors across dimensions."""
    size = lambda c: F.coalesce(F.abs(c), F.lit(0.0)).desc()
    order = [size("share_abs"), size("delta"), size("hist_delta"), F.asc("dimension"), F.asc("name")]
    best = top.where(F.col("position") <= per_dimension).orderBy(*order).limit(limit)
    return best.withColumn("impact_rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def in_month(spec: AnalysisSpec, period: str | None) -> Column:
    """Rows of one month (``yyyy-MM``): a half-open range of dates where the date column is there."""
    if spec.date is None or period is None:
        return F.col(spec.period) == F.lit(period)
    year, month = map(int, period.split("-"))
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    date, bound = F.col(spec.date), lambda day: F.lit(day).cast("timestamp_ntz")
    return (date >= bound(f"{period}-01")) & (date < bound(after))


def focus_months(focus: DataFrame) -> tuple[str | None, str | None]:
    """The focus month and the one before, read as plain values so that they prune the scan (one row)."""
    row = focus.select("period", "prev_period").first()
    return (row["period"], row["prev_period"]) if row else (None, None)


def contributor_context(df: DataFrame, spec: AnalysisSpec, top: DataFrame, focus: DataFrame) -> DataFrame:
    """For each contributor, the leading value of up to three other dimensions in the focus month."""
    month = df.where(in_month(spec, focus_months(focus)[0]) & F.col(spec.metric).isNotNull())
    options = []
    for dim in spec.dimensions:
        others = [d for d in spec.dimensions if d != dim][:3]
        related = F.array(
            *[F.struct(F.lit(o).alias("related"), F.col(o).cast("string").alias("related_name")) for o in others]
        )
        options.append(
            F.struct(F.lit(dim).alias("dimension"), F.col(dim).cast("string").alias("name"), related.alias("others"))
        )
    long = month.select(F.col(spec.metric).alias("value"), F.explode(F.array(*options)).alias("o")).select(
        "value", "o.*"
    )
    wanted = long.join(top.select("dimension", "name"), ["dimension", "name"], "left_semi")
    pairs = wanted.select("dimension", "name", "value", F.inline("others"))
    totals = (
        pairs.where(F.col("related_name").isNotNull())
        .groupBy("dimension", "name", "related", "related_name")
        .agg(F.sum("value").cast("double").alias("value"))
    )
    best = Window.partitionBy("dimension", "name", "related").orderBy(F.desc("value"), "related_name")
    return totals.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")


def context_text(context: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """``dimension: name | …`` per contributor, in the order of the dimensions."""
    order = first_match(*[(F.col("related") == d, i) for i, d in enumerate(spec.dimensions)])
    entry = F.struct(order.alias("o"), F.concat_ws(": ", "related", "related_name").alias("t"))
    listed = F.array_sort(F.collect_list(entry))
    return context.groupBy("dimension", "name").agg(
        F.array_join(F.transform(listed, lambda e: e["t"]), " | ").alias("context")
    )


def concentration(top: DataFrame) -> DataFrame:
    """Share of the first, first three and first five contributors per dimension."""
    upto = lambda n: round_to(F.sum(F.when(F.col("position") <= n, F.col("share_abs")).otherwise(0.0)))
    return top.groupBy("dimension").agg(upto(1).alias("top_1"), upto(3).alias("top_3"), upto(5).alias("coverage"))


def dimension_leads(top: DataFrame) -> DataFrame:
    """The first contributor of each dimension with its gap to history and priority."""
    leads = top.where(F.col("position") == 1)
    level = first_match(
        (F.col("share_abs") >= 0.8, "high"),
        ((F.col("share_abs") >= 0.6) | (F.col("recurrence") == "recurrent"), "medium"),
        default="low",
    )
    return leads.select(
        "dimension",
        "name",
        "share_abs",
        "recurrence",
        "concentration",
        "hist_mean",
        "hist_delta",
        round_to(ratio("hist_delta", "hist_mean")).alias("hist_delta_pct"),
        level.alias("priority"),
    )


def dimension_rank(spec: AnalysisSpec) -> Column:
    return first_match(*[(F.col("dimension") == d, i) for i, d in enumerate(spec.dimensions)])


def waterfall(top: DataFrame, spec: AnalysisSpec, focus: DataFrame, steps: int = 5) -> DataFrame:
    """Baseline, running contributors of the primary dimension, residual and final value."""
    primary = top.agg(F.min_by("dimension", dimension_rank(spec))).scalar()
    bars = top.where((F.col("dimension") == primary) & (F.col("position") <= steps))
    ends = focus.select("period", "prev_period", "value", "prev_value")
    base = ends.select(
        F.lit(0).cast("bigint").alias("step"),
        F.col("prev_period").alias("label"),
        F.lit("baseline").alias("kind"),
        F.lit(None).cast("double").alias("delta"),
        F.col("prev_value").alias("running_total"),
    )
    start = focus.select("prev_value").scalar()
    current = focus.select("value").scalar()
    running = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    middle = bars.select(
        F.col("position").alias("step"),
        F.col("name").alias("label"),
        F.when(F.col("delta") >= 0, "increase").otherwise("decrease").alias("kind"),
        F.col("delta"),
        (start + F.sum("delta").over(running)).alias("running_total"),
    )
    reached = bars.agg((current - start - F.coalesce(F.sum("delta"), F.lit(0.0))).alias("delta"))
    residual = reached.where(F.abs("delta") >= F.greatest(F.abs(current) * 0.01, F.lit(0.01))).select(
        F.lit(steps + 1).cast("bigint").alias("step"),
        F.lit("other_effects").alias("label"),
        F.when(F.col("delta") >= 0, "increase").otherwise("decrease").alias("kind"),
        F.col("delta"),
        current.alias("running_total"),
    )
    final = ends.select(
        F.lit(steps + 2).cast("bigint").alias("step"),
        F.col("period").alias("label"),
        F.lit("current").alias("kind"),
        F.lit(None).cast("double").alias("delta"),
        F.col("value").alias("running_total"),
    )
    chained = base.unionByName(middle).unionByName(residual).unionByName(final)
    return chained.select(
        "step", "label", "kind", round_to("delta").alias("delta"), round_to("running_total").alias("running_total")
    )


def quick_evidence(df: DataFrame, spec: AnalysisSpec, focus: DataFrame, limit: int = 3) -> DataFrame:
    """Entities present in both months, largest change first.

    When none is in both, the largest entity of the focus month stands in, without a change.
    """
    dim = spec.dimensions[0]
    month, before = focus_months(focus)
    valid = df.where(F.col(spec.metric).isNotNull() & F.col(dim).isNotNull())

    def totals(period: str | None, alias: str) -> DataFrame:
        rows = valid.where(in_month(spec, period))
        return rows.groupBy(F.col(dim).cast("string").alias("name")).agg(
            F.sum(spec.metric).cast("double").alias(alias)
        )

    now, then = totals(month, "current_value"), totals(before, "previous_value")
    both = now.join(then, "name").withColumn("delta", F.col("current_value") - F.col("previous_value"))
    top = both.orderBy(F.abs("delta").desc(), "name").limit(limit)
    missing = both.agg(F.count("*") == 0).scalar()
    empty = F.lit(None).cast("double")
    stand_in = (
        now.orderBy(F.desc("current_value"), "name")
        .limit(1)
        .where(missing)
        .select("name", "current_value", empty.alias("previous_value"), empty.alias("delta"))
    )
    rows = top.select("name", "current_value", "previous_value", "delta").unionByName(stand_in)
    return rows.select("name", *[round_to(c).alias(c) for c in ("current_value", "previous_value", "delta")])


def concentration_alerts(top: DataFrame) -> DataFrame:
    leads = top.where((F.col("position") == 1) & (F.col("share_abs") >= 0.6))
    return leads.select("dimension", "name", "share_abs", F.col("concentration").alias("level"))


def movement_alerts(
    series: DataFrame,
    spec: AnalysisSpec,
    top: DataFrame,
    cost: str | None = None,
    volume: str | None = None,
) -> DataFrame:
    """Fired alert codes with the month or entity they concern and their measure."""
    moved = movements(series)
    focus = focus_movement(moved)
    abnormal = abnormal_periods(moved).agg(F.count("*").cast("double").alias("measure"))
    alerts = [
        abnormal.where(F.col("measure") > 0).select(
            F.lit("abnormal_periods").alias("alert"), F.lit(None).cast("string").alias("subject"), "measure"
        )
    ]
    strong = focus.where(F.abs("pct") >= 0.5)
    alerts.append(strong.select(F.lit("critical_movement"), "period", "pct"))
    alerts.append(strong.select(F.when(F.col("pct") < 0, "large_drop").otherwise("large_rise"), "period", "pct"))
    gaps = series.agg(*[F.avg(F.col(s).isNull().cast("double")).alias(s) for s in spec.supports])
    long_gaps = gaps.unpivot([], list(spec.supports), "support", "measure").where(F.col("measure") > 0.2)
    alerts.append(long_gaps.select(F.lit("support_gaps"), "support", "measure"))
    if cost and volume:
        by_period = Window.orderBy("period")
        moves = series.select(
            "period",
            (F.col(cost) - F.lag(cost).over(by_period)).alias("cost_delta"),
            (F.col(volume) - F.lag(volume).over(by_period)).alias("volume_delta"),
        ).join(focus.select("period"), "period", "left_semi")
        crossed = moves.where((F.col("cost_delta") > 0) & (F.col("volume_delta") < 0))
        alerts.append(crossed.select(F.lit("cost_up_volume_down"), "period", "cost_delta"))
    lead = impact_ranking(top).where((F.col("impact_rank") == 1) & (F.col("share_abs") >= 0.8))
    alerts.append(
        lead.select(F.lit("dominant_contributor"), F.concat_ws(": ", "dimension", "name"), "share_abs")
    )
    leads = concentration_alerts(top)
    alerts.append(
        leads.select(
            F.concat(F.lit("concentration_"), F.col("level")), F.concat_ws(": ", "dimension", "name"), "share_abs"
        )
    )
    result = alerts[0]
    for other in alerts[1:]:
        result = result.union(other)
    return result.select("alert", "subject", round_to("measure").alias("measure"))


def confidence_levels(top: DataFrame, focus: DataFrame, evidence: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Confidence of the root cause and of the focus insight, from the evidence at hand."""
    primary = concentration(top).agg(
        F.count("*").alias("contributors"), F.min_by("coverage", dimension_rank(spec)).alias("coverage")
    )
    drivers = evidence.agg(F.count("*")).scalar()
    with_pct = focus.select(F.col("pct").isNotNull().cast("int")).scalar()
    found = (F.col("contributors") > 0).cast("int")
    explained = (drivers > 0).cast("int")
    covered = F.coalesce(F.col("coverage") >= 0.75, F.lit(False)).cast("int")
    scored = primary.select(
        stacked(
            ("scope", "score"),
            ("root_cause", found + explained + covered),
            ("focus_insight", F.lit(1) + explained + found + with_pct),
        )
    )
    root = F.col("scope") == "root_cause"
    level = first_match(
        (root & (F.col("score") >= 3), "high"),
        (root & (F.col("score") >= 1), "medium"),
        (root, "low"),
        (F.col("score") >= 4, "high"),
        (F.col("score") >= 2, "medium"),
        default="low",
    )
    return scored.select("scope", F.col("score").cast("bigint").alias("score"), level.alias("level"))


def focus_summary(focus: DataFrame) -> DataFrame:
    """The explained month in one row, against the previous month and its history."""
    gap = F.col("value") - F.col("hist_mean")
    return focus.select(
        "period",
        "prev_period",
        direction("delta").alias("direction"),
        *[round_to(c).alias(c) for c in ("value", "prev_value", "delta", "pct", "hist_mean")],
        round_to(gap).alias("hist_delta"),
        round_to(ratio(gap, "hist_mean")).alias("hist_delta_pct"),
        round_to("zscore").alias("zscore"),
    )
