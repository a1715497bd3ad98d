"""Column statistics and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from movara.functions.columns import round_to
from movara.functions.text import blank_to_null
from movara.operators import quality, stats
from movara.plans.registry import query
from movara.sources.mart import dirty_lines, table

DIRTY = """WITH d0 AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 40 ELSE l_extendedprice END AS price,
         CASE WHEN l_orderkey % 983 = 0 THEN NULL WHEN l_partkey % 9 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS net,
         CAST(CASE WHEN l_orderkey % 5 = 0 THEN 9 ELSE 1 END AS DOUBLE) AS flat,
         CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS flag,
         CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linestatus END AS status,
         CAST(NULL AS VARCHAR) AS note
  FROM lineitem
),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE l_orderkey % 50 = 0)"""

DIRTY_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber quantity price net flat flag status note".split()
)
MEASURES = ["quantity", "price", "net", "flat"]

MISSING = "miss AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, CAST(count({c}) = 0 AS INTEGER) AS empty FROM d"
    for c in DIRTY_COLUMNS
) + ")"

DUPLICATES = "dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n FROM d)"


def outlier_sql(source: str, columns: list[str], name: str = "ob") -> str:
    one = lambda c: f"""SELECT '{c}' AS "column", count({c}) AS n,
      CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / count({c}) AS mean,
      quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {source}"""  # noqa: E731
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)
    return f"""q AS ({" UNION ALL ".join(one(c) for c in columns)}),
vals AS ({long}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
      least(median * 5, median / 5) AS lo5, greatest(median * 5, median / 5) AS hi5 FROM q WHERE q3 <> q1),
cnt AS (SELECT "column", count(*) FILTER (WHERE value < lo OR value > hi) AS ic,
      count(*) FILTER (WHERE value < lo5 OR value > hi5) AS rc FROM vals JOIN b USING ("column") GROUP BY 1),
{name} AS (SELECT b."column", n, mean, median, CASE WHEN ic > 0 THEN 'iqr' ELSE 'ratio' END AS rule,
      CASE WHEN ic = 0 AND n >= 3 AND median <> 0 THEN lo5 ELSE lo END AS low,
      CASE WHEN ic = 0 AND n >= 3 AND median <> 0 THEN hi5 ELSE hi END AS high,
      CASE WHEN ic > 0 THEN ic WHEN n >= 3 AND median <> 0 THEN rc ELSE 0 END AS outliers
      FROM b JOIN cnt USING ("column"))"""


OUTLIERS = outlier_sql("d", MEASURES)

SCORE = f"""{MISSING},
{DUPLICATES},
{OUTLIERS},
raw AS (
  SELECT (SELECT count(*) FROM d) AS rows, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS columns,
         CAST((SELECT sum(missing) FROM miss) AS BIGINT) AS missing_total, CAST((SELECT n FROM dup) AS BIGINT) AS duplicate_rows,
         CAST((SELECT sum(empty) FROM miss) AS BIGINT) AS empty_columns,
         CAST((SELECT coalesce(sum(outliers), 0) FROM ob) AS BIGINT) AS outliers
),
pts AS (
  SELECT *, round(least(45.0, missing_total / greatest(rows * columns, 1) * 45.0), 2) AS missing_points,
         round(least(25.0, duplicate_rows / greatest(rows, 1) * 25.0), 2) AS duplicate_points,
         round(least(20.0, empty_columns / greatest(columns, 1) * 20.0), 2) AS empty_points,
         round(least(10.0, outliers / greatest(rows, 1) * 10.0), 2) AS outlier_points
  FROM raw
),
score AS (
  SELECT *, CAST(greatest(0, round_even(100 - (missing_points + duplicate_points + empty_points + outlier_points), 0)) AS BIGINT) AS score FROM pts
)"""


@query(
    "missing_top",
    f'{DIRTY}, {MISSING} SELECT "column", missing, row_number() OVER (ORDER BY missing DESC, "column") AS position FROM miss QUALIFY position <= 5',
)
def missing_top(spark, sf_dir):
    from pyspark.sql import Window

    counts = stats.missing_counts(dirty_lines(spark, sf_dir)).orderBy(F.desc("missing"), "column").limit(5)
    order = Window.orderBy(F.desc("missing"), "column")
    return counts.select("column", "missing", F.row_number().over(order).cast("bigint").alias("position"))


@query(
    "missing_summary",
    f"""{DIRTY}, {MISSING} SELECT "column", missing, empty, round(missing / (SELECT count(*) FROM d), 4) AS rate FROM miss
UNION ALL SELECT '__total__', CAST(sum(missing) AS BIGINT), CAST(sum(empty) AS INTEGER),
  round(sum(missing) / ((SELECT count(*) FROM d) * {len(DIRTY_COLUMNS)}), 4) FROM miss""",
)
def missing_summary(spark, sf_dir):
    df = dirty_lines(spark, sf_dir)
    rows = df.agg(F.count("*")).scalar()
    counts = stats.missing_counts(df)
    total = stats.missing_summary(df).select(
        F.lit("__total__").alias("column"),
        F.col("missing_total").alias("missing"),
        F.col("empty_columns").cast("int").alias("empty"),
        round_to(F.col("missing_total") / (rows * F.col("columns"))).alias("rate"),
    )
    return counts.withColumn("rate", round_to(F.col("missing") / rows)).unionByName(total)


@query("duplicate_rows", f"{DIRTY}, {DUPLICATES} SELECT CAST(n AS BIGINT) AS duplicate_rows FROM dup")
def duplicate_rows(spark, sf_dir):
    return stats.duplicate_rows(dirty_lines(spark, sf_dir))


def _stats_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE), 4) AS sum,
 round(CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / count({c}), 4) AS mean, round(CAST(min({c}) AS DOUBLE), 4) AS min,
 round(CAST(max({c}) AS DOUBLE), 4) AS max, round(count(*) FILTER (WHERE {c} < 0) / count({c}), 4) AS negative_rate,
 round(count(*) FILTER (WHERE {c} = 0) / count({c}), 4) AS zero_rate FROM {source}"""
        for c in columns
    )


_LINE_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_stats", _stats_sql("lineitem", _LINE_NUMBERS) + " UNION ALL " + _stats_sql("customer", ["c_acctbal"]))
def numeric_stats(spark, sf_dir):
    lines = stats.numeric_stats(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS)
    return lines.unionByName(stats.numeric_stats(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query(
    "numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
 round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(quantile_cont({c}, 0.25), 2) AS q25,
 round(quantile_cont({c}, 0.5), 2) AS q50, round(quantile_cont({c}, 0.75), 2) AS q75 FROM lineitem"""
        for c in _LINE_NUMBERS[1:]
    ),
)
def numeric_summary(spark, sf_dir):
    return stats.numeric_summary(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS[1:])


_QS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.999]


@query(
    "quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS q, round(CAST(quantile_cont({c}, {q}) AS DOUBLE), 4) AS value FROM lineitem"""
        for c in ("l_extendedprice", "l_quantity", "l_orderkey")
        for q in _QS
    ),
)
def quantiles(spark, sf_dir):
    columns = ["l_extendedprice", "l_quantity", "l_orderkey"]
    rows = stats.exact_quantiles(table(spark, sf_dir, "lineitem"), columns, _QS)
    return rows.select("column", "q", round_to("value").alias("value"))


@query(
    "column_samples",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", value, row_number() OVER (ORDER BY value) AS position
 FROM (SELECT DISTINCT {c} AS value FROM {t}) QUALIFY position <= 6"""
        for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))
    ),
)
def column_samples(spark, sf_dir):
    rows = stats.column_samples(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return rows.withColumn("position", F.col("position").cast("bigint"))


_OB = "round(low, 4) AS low, round(high, 4) AS high"


@query("iqr_outliers", f"{DIRTY}, {OUTLIERS} SELECT \"column\", rule, outliers, {_OB} FROM ob WHERE outliers > 0")
def iqr_outliers(spark, sf_dir):
    rows = quality.outlier_counts(dirty_lines(spark, sf_dir), MEASURES)
    return rows.select("column", "rule", "outliers", round_to("low").alias("low"), round_to("high").alias("high"))


@query(
    "ratio_outliers",
    "WITH " + outlier_sql("lineitem", ["l_quantity", "l_discount"])
    + f" SELECT \"column\", rule, outliers, {_OB} FROM ob WHERE rule = 'ratio'",
)
def ratio_outliers(spark, sf_dir):
    rows = quality.outlier_bounds(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return rows.where("rule = 'ratio'").select(
        "column", "rule", "outliers", round_to("low").alias("low"), round_to("high").alias("high")
    )


@query(
    "outlier_details",
    f"""{DIRTY}, k AS (SELECT *, l_orderkey * 8 + l_linenumber AS row_key FROM d), {OUTLIERS},
fl AS ({" UNION ALL ".join(f"SELECT row_key, '{c}' AS 'column', {c} AS value FROM k WHERE {c} IS NOT NULL" for c in MEASURES)}),
r AS (SELECT fl.row_key, fl.value, ob.*, row_number() OVER (PARTITION BY ob."column" ORDER BY abs(value - median) DESC, value DESC, row_key) AS position
      FROM fl JOIN ob ON fl."column" = ob."column" WHERE outliers > 0 AND (value < low OR value > high)),
x AS (SELECT "column", row_key, position, round(value, 4) AS value, round(mean, 4) AS mean,
      round(abs(value - mean) / CASE WHEN mean <> 0 THEN abs(mean) ELSE greatest(abs(median), 1.0) END, 2) AS deviation,
      round(low, 4) AS low, round(high, 4) AS high FROM r WHERE position <= 3)
SELECT * FROM x ORDER BY deviation DESC, "column", position LIMIT 12""",
)
def outlier_details(spark, sf_dir):
    df = dirty_lines(spark, sf_dir).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return quality.outlier_details(df, "row_key", MEASURES)


@query("quality_score", f"{DIRTY}, {SCORE} SELECT * FROM score")
def quality_score(spark, sf_dir):
    return quality.quality_score(dirty_lines(spark, sf_dir), MEASURES)


@query(
    "quality_rates",
    f"""{DIRTY}, {SCORE},
lab AS (SELECT *, CASE WHEN score >= 90 THEN 'consistent' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'review' ELSE 'critical' END AS label FROM score)
SELECT 'quality' AS indicator, CAST(score AS DOUBLE) AS value, label FROM lab
UNION ALL SELECT 'missing_pct', round(missing_total / greatest(rows * columns, 1) * 100, 2), label FROM lab
UNION ALL SELECT 'duplicate_pct', round(duplicate_rows / greatest(rows, 1) * 100, 2), label FROM lab
UNION ALL SELECT 'outlier_pct', round(outliers / greatest(rows, 1) * 100, 2), label FROM lab""",
)
def quality_rates(spark, sf_dir):
    return quality.quality_rates(quality.quality_score(dirty_lines(spark, sf_dir), MEASURES))


@query(
    "blank_to_null",
    """SELECT l_orderkey, l_linenumber, nullif(trim(CASE WHEN l_partkey % 13 = 0 THEN '  ' ELSE ' ' || l_linestatus END), '') AS status
FROM lineitem""",
)
def blank_to_null_rows(spark, sf_dir):
    raw = F.when(F.col("l_partkey") % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", blank_to_null(raw).alias("status"))


_BLANKED = {
    "flag": "CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE l_returnflag END",
    "status": "CASE WHEN l_partkey % 6 = 0 THEN '' ELSE l_linestatus END",
    "note": "CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE '' END",
}


@query(
    "drop_empty",
    "WITH r AS (SELECT "
    + ", ".join(f"nullif(trim({e}), '') AS {c}" for c, e in _BLANKED.items())
    + """ FROM lineitem),
k AS (SELECT * FROM r WHERE flag IS NOT NULL OR status IS NOT NULL OR note IS NOT NULL)
SELECT (SELECT count(*) FROM lineitem) AS rows_read, count(*) AS rows_kept,
       CAST((count(flag) > 0)::INT + (count(status) > 0)::INT + (count(note) > 0)::INT AS BIGINT) AS columns_kept FROM k""",
)
def drop_empty(spark, sf_dir):
    from movara.sources.cells import drop_empty_report

    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in _BLANKED.items()])
    return drop_empty_report(rows)
