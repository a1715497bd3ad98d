"""Flat result tables for BI tools, and their writer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from movara.functions.columns import round_to, stacked
from movara.functions.dates import month_period, period_month, period_year
from movara.functions.sharing import shared
from movara.operators import periods, rank, rootcause, stats
from movara.sources.mart import AnalysisSpec


def monthly_rows(series: DataFrame, spec: AnalysisSpec, months: int = 18) -> DataFrame:
    """Last months of the comparison; moving average and year to date restart at the cut."""
    compared = periods.last_periods(periods.monthly_comparison(series), months)
    drivers = periods.monthly_drivers(series, spec).where(F.col("position") == 1)
    main = drivers.select(
        "period",
        F.col("driver").alias("main_driver"),
        F.col("delta").alias("driver_delta"),
        F.col("pct").alias("driver_pct"),
    )
    rows = periods.with_year_to_date(periods.with_moving_average(compared)).join(main, "period", "left")
    money = lambda c: round_to(c, 2).alias(c)
    return rows.select(
        "period",
        period_year("period").alias("year"),
        period_month("period").alias("month"),
        *[money(c) for c in ("value", "prev_value", "delta")],
        round_to("pct").alias("pct"),
        *[money(c) for c in ("moving_avg", "ytd", "hist_mean")],
        round_to("zscore").alias("zscore"),
        "status",
        "main_driver",
        "driver_delta",
        "driver_pct",
    )


def _analysis(df: DataFrame, spec: AnalysisSpec) -> tuple[DataFrame, DataFrame]:
    series = shared(periods.monthly_sum(df, spec.metric, spec.period))
    return periods.focus_movement(periods.movements(series)), rootcause.contributors(df, spec, series=series)


def root_cause_rows(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Contributor rows and waterfall rows in one tagged table."""
    focus, top = _analysis(df, spec)
    context = rootcause.context_text(rootcause.contributor_context(df, spec, top, focus), spec)
    month, before = focus.select("period").scalar(), focus.select("prev_period").scalar()
    contributor = (
        top.join(context, ["dimension", "name"], "left")
        .withColumn("row_type", F.lit("contributor"))
        .withColumnRenamed("name", "entity")
        .drop("position")
    )
    primary = top.agg(F.min_by("dimension", rootcause.dimension_rank(spec))).scalar()
    steps = rootcause.waterfall(top, spec, focus).select(
        F.lit("waterfall").alias("row_type"),
        primary.alias("dimension"),
        F.col("label").alias("entity"),
        F.col("running_total").alias("current_value"),
        "delta",
        "step",
    )
    rows = contributor.unionByName(steps, allowMissingColumns=True)
    return rows.select(
        "row_type",
        month.alias("period"),
        before.alias("prev_period"),
        *[c for c in rows.columns if c != "row_type"],
    )


def dimension_rows(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """One row per dimension: movers, priority, concentration, history and context of the lead."""
    focus, top = _analysis(df, spec)
    context = rootcause.context_text(rootcause.contributor_context(df, spec, top, focus), spec)
    first_three = F.array_sort(F.collect_list(F.when(F.col("position") <= 3, F.struct("position", "name"))))
    movers = top.groupBy("dimension").agg(
        F.array_join(F.transform(first_three, lambda m: m["name"]), " | ").alias("main_movers")
    )
    leads = rootcause.dimension_leads(top).join(context, ["dimension", "name"], "left")
    joined = leads.join(rootcause.concentration(top), "dimension").join(movers, "dimension")
    return joined.select(
        "dimension",
        "main_movers",
        "priority",
        "top_1",
        "top_3",
        F.col("concentration").alias("level"),
        "hist_mean",
        "hist_delta",
        "context",
    )


def chart_rows(df: DataFrame, spec: AnalysisSpec, dimensions: list[str], limit: int = 8) -> DataFrame:
    """Points of the suggested charts: the month line, then one ranking per dimension."""
    series = periods.monthly_sum(df, spec.metric, spec.period)
    charts = [
        series.select(
            F.lit("monthly").alias("chart"),
            F.lit("line").alias("type"),
            F.col("period").alias("x"),
            round_to("value", 2).alias("y"),
            F.row_number().over(Window.orderBy("period")).cast("bigint").alias("point"),
            F.lit(1).cast("bigint").alias("chart_order"),
        )
    ]
    for order, dimension in enumerate(dimensions, start=2):
        ranked = rank.rank_by_sum(df, dimension, spec.metric, limit)
        charts.append(
            ranked.select(
                F.lit(f"ranking_{dimension}").alias("chart"),
                F.lit("bar").alias("type"),
                F.col("name").alias("x"),
                round_to("total", 2).alias("y"),
                F.row_number().over(Window.orderBy(F.desc("total"), "name")).cast("bigint").alias("point"),
                F.lit(order).cast("bigint").alias("chart_order"),
            )
        )
    result = charts[0]
    for chart in charts[1:]:
        result = result.unionByName(chart)
    return result


def indicator_rows(series: DataFrame, top: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Name / value / measure rows for KPI cards."""
    names = ("indicator", "value", "measure")
    ends = periods.extreme_movements(periods.with_movement(series)).select(
        stacked(
            names,
            ("metric", F.lit(spec.metric), F.lit(None).cast("double")),
            ("latest_period", F.col("latest.period"), round_to("latest.delta", 2)),
            ("largest_rise", F.col("rise.period"), round_to("rise.delta", 2)),
            ("largest_drop", F.col("drop.period"), round_to("drop.delta", 2)),
        )
    )
    extremes = periods.best_worst(series).select(
        stacked(
            names,
            ("best_month", F.col("best_period"), round_to("best_value", 2)),
            ("worst_month", F.col("worst_period"), round_to("worst_value", 2)),
        )
    )
    quarter = periods.last_three_months(series).select(
        F.lit("last_3_months").alias("indicator"),
        F.lit(None).cast("string").alias("value"),
        round_to("last3", 2).alias("measure"),
    )
    leads = top.where(F.col("position") == 1)
    per_dimension = leads.select(
        F.concat(F.lit("lead_"), F.col("dimension")).alias("indicator"),
        F.col("name").alias("value"),
        F.col("share_abs").alias("measure"),
    )
    main = leads.orderBy(rootcause.dimension_rank(spec)).limit(1)
    primary = main.select(
        F.lit("main_contributor").alias("indicator"), F.col("name").alias("value"), F.col("share_abs").alias("measure")
    )
    return ends.unionByName(extremes).unionByName(quarter).unionByName(per_dimension).unionByName(primary)


def report_facts(df: DataFrame, ts: str, metric: str, first_numeric: str) -> DataFrame:
    """Peak of the business series, a column total, the worst-missing column, repeated rows."""
    by_month = df.where(F.col(metric).isNotNull()).groupBy(month_period(ts).alias("period")).agg(
        F.sum(F.col(metric).cast("decimal(18,2)")).cast("double").alias("value")
    )
    fact = lambda frame, name, subject, value: frame.select(
        F.lit(name).alias("fact"), subject.cast("string").alias("subject"), value.cast("double").alias("value")
    )
    peak = fact(periods.best_worst(by_month), "peak_point", F.col("best_period"), F.col("best_value"))
    total = fact(df.agg(F.sum(first_numeric).alias("t")), "first_numeric_total", F.lit(first_numeric), F.col("t"))
    worst = stats.missing_counts(df).agg(
        F.min_by(F.struct("column", "missing"), F.struct(-F.col("missing"), F.col("column"))).alias("w")
    )
    missing = fact(worst, "worst_missing", F.col("w.column"), F.col("w.missing"))
    repeated = fact(stats.duplicate_rows(df), "duplicates", F.lit(None), F.col("duplicate_rows"))
    return peak.unionByName(total).unionByName(missing).unionByName(repeated)


def evidence_bundle(series: DataFrame, top: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The analysis evidence as one JSON document.

    Every list is bounded: twelve movements, three measures, eight entities, eight months.
    """
    moved = periods.movements(series)
    focus = periods.focus_movement(moved)
    movement = F.struct(
        "period", *[round_to(c).alias(c) for c in ("value", "delta", "pct", "hist_mean", "zscore")]
    )

    def listed(df: DataFrame, entry, order):
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e"))))
        return df.agg(F.transform(pairs, lambda p: p["e"])).scalar()

    last = periods.last_periods(moved.where(F.col("delta").isNotNull()), 12)
    odd = periods.abnormal_periods(moved).orderBy(F.abs("delta").desc(), "period").limit(8)
    impact = rootcause.impact_ranking(top, limit=8)
    drivers = periods.driver_evidence(series, spec, focus)
    driver_entry = F.struct("driver", "current_value", "previous_value", "delta", "correlation")
    impact_entry = F.struct("dimension", "name", "delta", "share_abs", "concentration", "recurrence")
    return focus.select(
        F.col("period").alias("focus_period"),
        F.to_json(
            F.struct(
                F.lit(spec.metric).alias("metric"),
                listed(last, movement, F.col("period")).alias("movements"),
                listed(drivers, driver_entry, -F.abs(F.coalesce("correlation", F.lit(0.0)))).alias("drivers"),
                listed(impact, impact_entry, F.col("impact_rank")).alias("impact"),
                listed(odd, movement, -F.abs("delta")).alias("abnormal"),
            )
        ).alias("evidence"),
    )


def write_tables(tables: dict[str, DataFrame], path: str, metadata: DataFrame | None = None) -> None:
    """Write each result as a headed CSV folder next to JSON metadata; every write is distributed."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{path}/{name}")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_package(tables: Mapping[str, DataFrame], path: str, partitions: Mapping[str, Sequence[str]] | None = None, about: Mapping[str, str] | None = None) -> None:
    """Every result as a headed CSV table, with a manifest of what was written.

    A table with ``partitions`` is laid out by these columns, and a later package replaces only the partitions that it has
    rows of, so a month can be delivered again by itself. The manifest, one JSON row a table, has the rows (counted by the
    write), the schema, the partition columns and ``about``.
    """
    entries, partitions = [], partitions or {}
    spark = None
    for name, df in tables.items():
        spark, by, seen = df.sparkSession, list(partitions.get(name, ())), Observation(name)
        counted = df.observe(seen, F.count("*").alias("rows"))
        writer = counted.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*by) if by else writer).csv(f"{path}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        entries.append((name, seen.get["rows"], schema, by, dict(about or {})))
    if spark is not None:
        manifest = spark.createDataFrame(entries, "table string, rows long, schema string, partitions array<string>, about map<string,string>")
        manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a package under their schemas, as the manifest names them, and the ``manifest`` itself."""
    manifest = spark.read.schema("table string, rows long, schema string, partitions array<string>, about map<string,string>").json(f"{path}/manifest")
    tables = {"manifest": manifest}
    for entry in manifest.collect():
        columns = spark.createDataFrame([], entry.schema).schema
        tables[entry.table] = spark.read.schema(columns).option("header", True).csv(f"{path}/{entry.table}").select(columns.fieldNames())
    return tables
