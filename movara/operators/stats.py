"""Column statistics over whole tables.

Per-column figures come from one wide aggregate whose single row is then turned long,
so the facts are never multiplied by the number of columns. Exact quantiles are the
exception; they are found by rank inside narrow value brackets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import exact_sum, long_form, nan_to_null, numeric_columns, round_to

SKETCH_ACCURACY = 4000
BRACKET = 0.002
SKETCH_SHARDS = 16
BINS = 1024


def per_column(df: DataFrame, columns: Iterable[str], measures) -> DataFrame:
    """Run ``measures(column)`` (a dict of aggregates) for each column in one pass, one row per column."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[expr.alias(name) for name, expr in measures(c).items()])
        for c in columns
    ]
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def missing_counts(df: DataFrame) -> DataFrame:
    return per_column(
        nan_to_null(df), df.columns, lambda c: {"missing": F.count_if(F.col(c).isNull()), "rows": F.count("*")}
    ).select("column", "missing", (F.col("missing") == F.col("rows")).cast("int").alias("empty"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells, their rate, and the number of fully empty columns."""
    return missing_counts(df).agg(
        F.sum("missing").alias("missing_total"),
        F.sum(F.col("empty").cast("bigint")).alias("empty_columns"),
        F.count("*").alias("columns"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, nulls being equal.

    Row hashes are counted first, eight bytes per row; only rows whose hash repeats are
    then compared in full, so hash collisions cannot change the count.
    """
    keyed = df.withColumn("_hash", F.xxhash64(*df.columns))
    repeated = keyed.groupBy("_hash").count().where(F.col("count") > 1).select("_hash")
    suspects = keyed.join(repeated, "_hash", "left_semi")
    groups = suspects.groupBy("_hash", *df.columns).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def numeric_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Count, sum, mean, extremes and negative / zero rates per numeric column."""

    def measures(c: str) -> dict[str, Column]:
        v = F.col(c).cast("double")
        total = exact_sum(v)
        return {
            "count": F.count(v),
            "sum": round_to(total),
            "mean": round_to(F.try_divide(total, F.count(v))),
            "min": round_to(F.min(v)),
            "max": round_to(F.max(v)),
            "negative_rate": round_to(F.try_divide(F.count_if(v < 0), F.count(v))),
            "zero_rate": round_to(F.try_divide(F.count_if(v == 0), F.count(v))),
        }

    columns = list(columns or numeric_columns(df))
    return per_column(nan_to_null(df, *columns), columns, measures).where(F.col("count") > 0)


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Distinct values with their counts; a hot value is one row from here on."""
    long = long_form(df, [], columns, "column", "value", "double")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("copies"))


def exact_quantiles(df: DataFrame, columns: Iterable[str], quantiles: Iterable[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (column, q).

    Sketches bracket each quantile: rows are dealt to a few shards one by one, so that ordered input spreads too, and
    the lowest lower cut and highest upper cut over the shards hold the quantile of the whole column. The
    distinct values inside are counted by bin, and only the bins that the wanted ranks fall into are ordered.
    """
    columns = list(columns)
    df = nan_to_null(df, *columns)
    quantiles = [float(q) for q in quantiles]
    low = [max(q - BRACKET, 0.0) for q in quantiles]
    high = [min(q + BRACKET, 1.0) for q in quantiles]
    probes = F.array(*[F.lit(p) for p in low + high])

    def measures(c: str) -> dict[str, Column]:
        v = F.col(c).cast("double")
        return {
            "n": F.count(v),
            "least": F.min(v),
            "most": F.max(v),
            "cuts": F.percentile_approx(v, probes, SKETCH_ACCURACY),
        }

    shard = F.pmod(F.monotonically_increasing_id(), F.lit(SKETCH_SHARDS)).alias("_shard")
    structs = [F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in measures(c).items()]) for c in columns]
    shards = df.select(*columns, shard).groupBy("_shard").agg(F.array(*structs).alias("rows"))
    last = len(quantiles)
    sketch = (
        shards.select(F.inline("rows"))
        .where(F.col("n") > 0)
        .groupBy("column")
        .agg(
            F.sum("n").alias("n"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
            *[F.min(F.col("cuts")[i]).alias(f"low{i}") for i in range(last)],
            *[F.max(F.col("cuts")[last + i]).alias(f"high{i}") for i in range(last)],
        )
    )
    few = F.col("n") * BRACKET < 1  # the bracket is narrower than one row there

    def bracket(i: int, q: float) -> Column:
        open_low = few | F.lit(low[i] <= 0.0)
        open_high = few | F.lit(high[i] >= 1.0)
        return F.struct(
            F.lit(q).alias("q"),
            F.when(open_low, F.col("least")).otherwise(F.col(f"low{i}")).alias("lo"),
            F.when(open_high, F.col("most")).otherwise(F.col(f"high{i}")).alias("hi"),
            (F.lit(q) * (F.col("n") - 1)).alias("pos"),
        )

    brackets = sketch.select(
        "column", F.inline(F.array(*[bracket(i, q) for i, q in enumerate(quantiles)]))
    )
    counts = value_counts(df, columns).join(brackets, "column")
    below = counts.groupBy("column", "q").agg(
        F.sum(F.when(F.col("value") < F.col("lo"), F.col("copies")).otherwise(0)).alias("below")
    )
    width = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    inside = counts.where(F.col("value").between(F.col("lo"), F.col("hi"))).withColumn(
        "bin", F.coalesce(F.floor(width * BINS), F.lit(0))
    )
    filled = inside.groupBy("column", "q", "bin").agg(F.sum("copies").alias("held"), F.max("pos").alias("pos"))
    in_order = Window.partitionBy("column", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = filled.join(below, ["column", "q"]).withColumn("end", F.col("below") + F.sum("held").over(in_order))
    wanted = reached.where((F.col("end") > F.floor("pos")) & (F.col("end") - F.col("held") <= F.ceil("pos"))).select(
        "column", "q", "bin", (F.col("end") - F.col("held")).alias("earlier")
    )
    upto = Window.partitionBy("column", "q", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        inside.join(wanted, ["column", "q", "bin"])
        .withColumn("end", F.col("earlier") + F.sum("copies").over(upto))
        .withColumn("start", F.col("end") - F.col("copies"))
    )
    floor, ceil = F.floor("pos"), F.ceil("pos")
    holds = lambda rank: (F.col("start") <= rank) & (rank < F.col("end"))
    ends = ranked.groupBy("column", "q").agg(
        F.max(F.when(holds(floor), F.col("value"))).alias("a"),
        F.max(F.when(holds(ceil), F.col("value"))).alias("b"),
        F.max(F.col("pos") - floor).alias("part"),
    )
    return ends.select("column", "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def quantile_table(df: DataFrame, columns: Iterable[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with one named column each."""
    long = exact_quantiles(df, columns, quantiles.values())
    picks = [F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in quantiles.items()]
    return long.groupBy("column").agg(*picks)


def numeric_summary(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    columns = list(columns or numeric_columns(df))
    df = nan_to_null(df, *columns)

    def measures(c: str) -> dict[str, Column]:
        v = F.col(c).cast("double")
        return {
            "count": F.count(v),
            "mean": round_to(F.avg(v), 2),
            "std": round_to(F.stddev_samp(v), 2),
            "min": round_to(F.min(v), 2),
            "max": round_to(F.max(v), 2),
        }

    quartiles = quantile_table(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rounded = quartiles.select("column", *[round_to(q, 2).alias(q) for q in ("q25", "q50", "q75")])
    return per_column(df, columns, measures).join(rounded, "column", "left")


def column_samples(df: DataFrame, columns: Iterable[str], size: int = 6) -> DataFrame:
    """The smallest distinct values of each column as text (a deterministic sample)."""
    long = long_form(df, [], columns, "column", "value", "string").where(F.col("value").isNotNull())
    distinct = long.distinct()
    smallest = Window.partitionBy("column").orderBy("value")
    return distinct.withColumn("position", F.row_number().over(smallest)).where(F.col("position") <= size)


def date_span(df: DataFrame, column: str) -> DataFrame:
    """First and last date and the number of observed months (months collapse before counting)."""
    by_month = df.where(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("m")).agg(
        F.min(column).alias("first"), F.max(column).alias("last")
    )
    return by_month.agg(
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_date"),
        F.count("*").alias("months"),
    )
