"""Month-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movara.functions.columns import ratio, round_to
from movara.functions.sharing import shared
from movara.operators import periods as P
from movara.plans import sql as S
from movara.plans.registry import query
from movara.sources.mart import AnalysisSpec, sales_mart, table

SPEC = AnalysisSpec()


def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = sales_mart(spark, sf_dir, "period", "amount", *SPEC.support_columns)
    return shared(P.period_metrics(mart, SPEC))


def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(P.monthly_sum(sales_mart(spark, sf_dir, "period", "amount"), "amount"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.movements(value_series(spark, sf_dir))


@query(
    "monthly_comparison",
    S.SERIES
    + f"""
SELECT period, round(value, 4) AS value, round(prev_value, 4) AS prev_value, round(delta, 4) AS delta,
       round(pct, 4) AS pct, round(hist_mean, 4) AS hist_mean, round(hist_std, 4) AS hist_std,
       round(zscore, 4) AS zscore, {S.STATUS} AS status,
       CASE {S.STATUS} WHEN 'critical' THEN 'danger' WHEN 'outlier' THEN 'warning' WHEN 'relevant' THEN 'warning'
         WHEN 'up' THEN 'info' WHEN 'down' THEN 'info' ELSE 'neutral' END AS tone
FROM v""",
)
def monthly_comparison(spark, sf_dir):
    return P.movement_table(value_series(spark, sf_dir))


@query("monthly_sum", S.SERIES + " SELECT period, round(value, 2) AS total FROM v")
def monthly_sum(spark, sf_dir):
    return value_series(spark, sf_dir).select("period", round_to("value", 2).alias("total"))


@query(
    "best_month",
    S.SERIES + " SELECT period, round(value, 2) AS total FROM v ORDER BY value DESC, period LIMIT 1",
)
def best_month(spark, sf_dir):
    return P.best_worst(value_series(spark, sf_dir)).select(
        F.col("best_period").alias("period"), round_to("best_value", 2).alias("total")
    )


@query(
    "period_metrics",
    S.SERIES
    + """ SELECT period, round(value, 2) AS value, round(quantity, 2) AS quantity,
       round(discount, 6) AS discount, round(margin_rate, 6) AS margin_rate FROM s""",
)
def period_metrics(spark, sf_dir):
    return full_series(spark, sf_dir).select(
        "period",
        round_to("value", 2).alias("value"),
        round_to("quantity", 2).alias("quantity"),
        round_to("discount", 6).alias("discount"),
        round_to("margin_rate", 6).alias("margin_rate"),
    )


@query(
    "best_worst_month",
    S.SERIES
    + """ SELECT (SELECT period FROM v ORDER BY value DESC, period LIMIT 1) AS best_period,
       (SELECT round(value, 2) FROM v ORDER BY value DESC, period LIMIT 1) AS best_value,
       (SELECT period FROM v ORDER BY value, period LIMIT 1) AS worst_period,
       (SELECT round(value, 2) FROM v ORDER BY value, period LIMIT 1) AS worst_value""",
)
def best_worst_month(spark, sf_dir):
    return P.best_worst(value_series(spark, sf_dir)).select(
        "best_period",
        round_to("best_value", 2).alias("best_value"),
        "worst_period",
        round_to("worst_value", 2).alias("worst_value"),
    )


def _one_figure(name: str, column: str) -> None:
    @query(name, S.SERIES + f" SELECT period, round({column}, 4) AS {column} FROM v")
    def run(spark, sf_dir):
        return moved(spark, sf_dir).select("period", round_to(column).alias(column))


for _name, _column in (
    ("mom_delta", "delta"),
    ("mom_pct", "pct"),
    ("hist_mean", "hist_mean"),
    ("hist_std", "hist_std"),
    ("zscore", "zscore"),
):
    _one_figure(_name, _column)


@query(
    "moving_avg3",
    S.SERIES
    + """ SELECT period, round(CAST(sum(CAST(value AS DECIMAL(38,10))) OVER w AS DOUBLE) / count(*) OVER w, 4)
       AS moving_avg FROM v WINDOW w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def moving_avg3(spark, sf_dir):
    return P.with_moving_average(value_series(spark, sf_dir)).select("period", round_to("moving_avg").alias("moving_avg"))


@query(
    "ytd",
    S.SERIES
    + """ SELECT period, round(sum(value) OVER (PARTITION BY substr(period, 1, 4) ORDER BY period), 2) AS ytd FROM v""",
)
def ytd(spark, sf_dir):
    return P.with_year_to_date(value_series(spark, sf_dir)).select("period", round_to("ytd", 2).alias("ytd"))


@query(
    "last3_vs_prev3",
    S.SERIES
    + """, r AS (SELECT value, row_number() OVER (ORDER BY period DESC) AS age FROM v),
t AS (SELECT sum(CASE WHEN age <= 3 THEN value END) AS last3, coalesce(sum(CASE WHEN age BETWEEN 4 AND 6 THEN value END), 0) AS prev3 FROM r)
SELECT round(last3, 2) AS last3, round(prev3, 2) AS prev3, round(last3 - prev3, 2) AS delta,
       round((last3 - prev3) / nullif(abs(prev3), 0), 4) AS pct FROM t""",
)
def last3_vs_prev3(spark, sf_dir):
    return P.last_three_months(value_series(spark, sf_dir)).select(
        *[round_to(c, 2).alias(c) for c in ("last3", "prev3", "delta")], round_to("pct").alias("pct")
    )


_YTD_SQL = """, latest AS (SELECT max(period) AS p FROM v),
y AS (SELECT sum(CASE WHEN substr(period,1,4) = substr(p,1,4) THEN value END) AS ytd,
             sum(CASE WHEN CAST(substr(period,1,4) AS INT) = CAST(substr(p,1,4) AS INT) - 1 THEN value END) AS prev_ytd,
             max(p) AS latest_period
      FROM v, latest WHERE substr(period,6,2) <= substr(p,6,2))"""


@query(
    "ytd_vs_prev_year",
    S.SERIES
    + _YTD_SQL
    + """ SELECT latest_period, round(ytd, 2) AS ytd, round(prev_ytd, 2) AS prev_ytd,
       round(ytd - prev_ytd, 2) AS delta, round((ytd - prev_ytd) / nullif(abs(prev_ytd), 0), 4) AS pct FROM y""",
)
def ytd_vs_prev_year(spark, sf_dir):
    return P.year_to_date_comparison(value_series(spark, sf_dir)).select(
        "latest_period",
        *[round_to(c, 2).alias(c) for c in ("ytd", "prev_ytd", "delta")],
        round_to("pct").alias("pct"),
    )


_DRIVERS_SQL = """, d AS (
  SELECT period, 'quantity' AS driver, 0 AS o, quantity AS cur, lag(quantity) OVER (ORDER BY period) AS prv FROM s
  UNION ALL SELECT period, 'discount', 1, discount, lag(discount) OVER (ORDER BY period) FROM s
  UNION ALL SELECT period, 'margin_rate', 2, margin_rate, lag(margin_rate) OVER (ORDER BY period) FROM s
),
dr AS (
  SELECT period, driver, o, round(cur, 4) AS current_value, round(prv, 4) AS previous_value,
         round(cur - prv, 4) AS delta, round((cur - prv) / nullif(abs(prv), 0), 4) AS pct
  FROM d WHERE prv IS NOT NULL
),
drr AS (
  SELECT *, row_number() OVER (PARTITION BY period
      ORDER BY greatest(abs(coalesce(pct, 0)), abs(delta) / 1000) DESC, o) AS position FROM dr
)"""


@query(
    "monthly_drivers",
    S.SERIES
    + _DRIVERS_SQL
    + " SELECT period, driver, current_value, previous_value, delta, pct, position FROM drr",
)
def monthly_drivers(spark, sf_dir):
    return P.monthly_drivers(full_series(spark, sf_dir), SPEC).withColumn("position", F.col("position").cast("bigint"))


@query(
    "trend6",
    S.SERIES
    + """, t AS (SELECT period, value FROM v ORDER BY period DESC LIMIT 6),
e AS (SELECT min(period) AS start_period, max(period) AS end_period, count(*) AS months,
             arg_min(value, period) AS a, arg_max(value, period) AS b FROM t)
SELECT start_period, end_period, months, round(b - a, 4) AS change, round((b - a) / nullif(abs(a), 0), 4) AS change_pct,
       CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS direction FROM e""",
)
def trend6(spark, sf_dir):
    return P.trend(value_series(spark, sf_dir))


@query(
    "first_last_growth",
    S.SERIES
    + """, e AS (SELECT min(period) AS start_period, max(period) AS end_period,
             arg_min(value, period) AS a, arg_max(value, period) AS b FROM v)
SELECT start_period, end_period, round(b - a, 4) AS change, round((b - a) / nullif(abs(a), 0), 4) AS change_pct,
       CASE WHEN b - a >= 0 THEN 'up' ELSE 'down' END AS direction FROM e""",
)
def first_last_growth(spark, sf_dir):
    series = value_series(spark, sf_dir)
    ends = series.agg(
        F.min("period").alias("start_period"),
        F.max("period").alias("end_period"),
        F.min_by("value", "period").alias("a"),
        F.max_by("value", "period").alias("b"),
    )
    change = F.col("b") - F.col("a")
    return ends.select(
        "start_period",
        "end_period",
        round_to(change).alias("change"),
        round_to(ratio(change, "a")).alias("change_pct"),
        F.when(change >= 0, "up").otherwise("down").alias("direction"),
    )


@query(
    "point_moves",
    S.SERIES
    + """, p AS (SELECT *, delta / nullif(abs(prev_value), 0) AS q FROM v)
SELECT period, round(value, 4) AS value, round(prev_value, 4) AS prev_value, round(delta, 4) AS delta, round(q, 4) AS pct,
       CAST(coalesce(abs(q) >= 0.5, FALSE) AS INTEGER) AS strong_move,
       CASE WHEN abs(q) >= 0.5 AND delta < 0 THEN 'warning' WHEN abs(q) >= 0.5 THEN 'good' ELSE 'neutral' END AS severity,
       round(abs(value) / nullif(sum(abs(value)) OVER (), 0), 6) AS share FROM p""",
)
def point_moves(spark, sf_dir):
    moves = P.point_moves(value_series(spark, sf_dir))
    figures = {"value": 4, "prev_value": 4, "delta": 4, "pct": 4, "share": 6}
    return moves.select(*[round_to(c, figures[c]).alias(c) if c in figures else F.col(c) for c in moves.columns])


@query(
    "focus_movement",
    S.CLOSED
    + """ SELECT 'focus' AS movement, period, prev_period, round(value, 2) AS value, round(delta, 2) AS delta, round(pct, 4) AS pct FROM focus
UNION ALL (SELECT 'latest', period, prev_period, round(value, 2), round(delta, 2), round(pct, 4) FROM v ORDER BY period DESC LIMIT 1)""",
)
def focus_movement(spark, sf_dir):
    rows = moved(spark, sf_dir)
    columns = [
        "movement",
        "period",
        "prev_period",
        round_to("value", 2).alias("value"),
        round_to("delta", 2).alias("delta"),
        round_to("pct").alias("pct"),
    ]
    focus = P.focus_movement(rows).withColumn("movement", F.lit("focus")).select(*columns)
    latest = P.latest_movement(rows).withColumn("movement", F.lit("latest")).select(*columns)
    return focus.unionByName(latest)


_ABNORMAL_SQL = """, cut AS (
  SELECT coalesce(greatest(quantile_cont(abs(pct), 0.8), 0.25), 0.25) AS threshold FROM v WHERE delta IS NOT NULL
),
ab AS (
  SELECT v.*, threshold FROM v, cut
  WHERE delta IS NOT NULL AND (abs(pct) >= threshold OR coalesce(abs(zscore), 0) >= 2)
)"""


@query(
    "abnormal_periods",
    S.SERIES
    + _ABNORMAL_SQL
    + """ SELECT period, round(value, 2) AS value, round(delta, 2) AS delta, round(pct, 4) AS pct,
       round(zscore, 4) AS zscore, round(threshold, 6) AS threshold,
       row_number() OVER (ORDER BY abs(delta) DESC, period) AS position FROM ab""",
)
def abnormal_periods(spark, sf_dir):
    from pyspark.sql import Window

    rows = P.abnormal_periods(moved(spark, sf_dir))
    by_size = Window.orderBy(F.abs("delta").desc(), "period")
    return rows.select(
        "period",
        round_to("value", 2).alias("value"),
        round_to("delta", 2).alias("delta"),
        round_to("pct").alias("pct"),
        round_to("zscore").alias("zscore"),
        round_to("threshold", 6).alias("threshold"),
        F.row_number().over(by_size).cast("bigint").alias("position"),
    )


_CARDS_SQL = (
    _YTD_SQL
    + """, r AS (SELECT value, row_number() OVER (ORDER BY period DESC) AS age FROM v),
q AS (SELECT sum(CASE WHEN age <= 3 THEN value END) AS last3, coalesce(sum(CASE WHEN age BETWEEN 4 AND 6 THEN value END), 0) AS prev3,
             CAST(sum(CASE WHEN age <= 3 THEN CAST(value AS DECIMAL(38,10)) END) AS DOUBLE) / count(CASE WHEN age <= 3 THEN 1 END) AS avg3, max(CASE WHEN age = 1 THEN value END) AS lv FROM r),
cards AS (
  SELECT 1 AS position, 'last_3_months' AS card, last3 AS value, last3 - prev3 AS delta, (last3 - prev3) / nullif(abs(prev3), 0) AS pct,
         CAST(NULL AS VARCHAR) AS period, 's' AS t FROM q
  UNION ALL SELECT 2, 'year_to_date', ytd, ytd - prev_ytd, (ytd - prev_ytd) / nullif(abs(prev_ytd), 0), latest_period, 's' FROM y
  UNION ALL SELECT 3, 'moving_average_3', avg3, lv - avg3, (lv - avg3) / nullif(abs(avg3), 0), NULL, 's' FROM q
  UNION ALL (SELECT 4, 'best_month', value, NULL, NULL, period, 'good' FROM v ORDER BY value DESC, period LIMIT 1)
  UNION ALL (SELECT 5, 'worst_month', value, NULL, NULL, period, 'warning' FROM v ORDER BY value, period LIMIT 1)
)"""
)


@query(
    "comparative_cards",
    S.SERIES
    + _CARDS_SQL
    + """ SELECT CAST(position AS BIGINT) AS position, card, round(value, 2) AS value, round(delta, 2) AS delta, round(pct, 4) AS pct, period,
       CASE WHEN t <> 's' THEN t WHEN delta > 0 THEN 'good' WHEN delta < 0 THEN 'warning' ELSE 'neutral' END AS tone FROM cards""",
)
def comparative_cards(spark, sf_dir):
    return P.comparative_cards(value_series(spark, sf_dir))


_YOY_SQL = """, yo AS (
  SELECT a.*, b.value AS previous_year_value FROM v a
  LEFT JOIN v b ON CAST(substr(b.period,1,4) AS INT) = CAST(substr(a.period,1,4) AS INT) - 1
               AND substr(a.period,6,2) = substr(b.period,6,2)
)"""


@query(
    "yoy_month",
    S.SERIES
    + _YOY_SQL
    + """ SELECT period, round(value, 2) AS value, round(previous_year_value, 2) AS previous_year_value,
       round(value - previous_year_value, 2) AS delta,
       round((value - previous_year_value) / nullif(abs(previous_year_value), 0), 4) AS pct FROM yo""",
)
def yoy_month(spark, sf_dir):
    return P.year_over_year(value_series(spark, sf_dir)).select(
        "period",
        *[round_to(c, 2).alias(c) for c in ("value", "previous_year_value", "delta")],
        round_to("pct").alias("pct"),
    )


_SLICE = "WHERE substr(period,1,4) = '2000' AND CAST(substr(period,6,2) AS INT) BETWEEN 2 AND 9"


@query("period_slice", S.SERIES + f" SELECT period, round(value, 2) AS value FROM v {_SLICE}")
def period_slice(spark, sf_dir):
    rows = P.period_slice(value_series(spark, sf_dir), 2000, 9, 2)
    return rows.select("period", round_to("value", 2).alias("value"))


@query(
    "slice_summary",
    S.SERIES
    + _YOY_SQL
    + f""", sl AS (SELECT * FROM yo {_SLICE}),
t AS (SELECT sum(value) AS total, CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS mean, sum(previous_year_value) AS py FROM sl)
SELECT round(total, 2) AS total, round(mean, 6) AS monthly_mean,
       (SELECT period FROM sl ORDER BY value DESC, period LIMIT 1) AS best_period,
       (SELECT period FROM sl ORDER BY value, period LIMIT 1) AS worst_period,
       (SELECT period FROM sl WHERE delta IS NOT NULL ORDER BY delta DESC, period LIMIT 1) AS rise_period,
       (SELECT period FROM sl WHERE delta IS NOT NULL ORDER BY delta, period LIMIT 1) AS drop_period,
       round(py, 2) AS previous_year_total, round(total - py, 2) AS delta,
       round((total - py) / nullif(abs(py), 0), 4) AS pct FROM t""",
)
def slice_summary(spark, sf_dir):
    rows = P.slice_summary(value_series(spark, sf_dir), 2000, 2, 9)
    places = {"total": 2, "previous_year_total": 2, "delta": 2, "monthly_mean": 6, "pct": 4}
    return rows.select(*[round_to(c, places[c]).alias(c) if c in places else F.col(c) for c in rows.columns])


@query(
    "movement_kpis",
    S.SERIES
    + """, ok AS (SELECT * FROM v WHERE delta IS NOT NULL)
(SELECT 'latest_period' AS kpi, period AS label, round(value, 2) AS amount, CAST(NULL AS DOUBLE) AS pct FROM ok ORDER BY period DESC LIMIT 1)
UNION ALL (SELECT 'latest_change', period, round(delta, 2), round(pct, 4) FROM ok ORDER BY period DESC LIMIT 1)
UNION ALL (SELECT 'largest_rise', period, round(delta, 2), NULL FROM ok ORDER BY delta DESC, period LIMIT 1)
UNION ALL (SELECT 'largest_drop', period, round(delta, 2), NULL FROM ok ORDER BY delta, period LIMIT 1)
UNION ALL SELECT 'periods', min(period) || '..' || max(period), CAST(count(*) AS DOUBLE), NULL FROM v""",
)
def movement_kpis(spark, sf_dir):
    return P.movement_kpis(moved(spark, sf_dir))


def _corr_sql(driver: str) -> str:
    return (
        f"SELECT '{driver}' AS driver, CASE WHEN count(*) >= 3 AND min(value) <> max(value) AND min({driver}) <> max({driver}) "
        f"THEN round(covar_samp(value, {driver}) / (stddev_samp(value) * stddev_samp({driver})), 3) END AS correlation FROM s"
    )


_CORR_SQL = ", corr AS (" + " UNION ALL ".join(_corr_sql(d) for d in ("quantity", "discount", "margin_rate")) + ")"


@query("driver_corr", S.SERIES + _CORR_SQL + " SELECT driver, correlation FROM corr")
def driver_corr(spark, sf_dir):
    return P.driver_correlation(full_series(spark, sf_dir), SPEC)


@query(
    "driver_evidence",
    S.CLOSED
    + _DRIVERS_SQL
    + _CORR_SQL
    + """ SELECT driver, current_value, previous_value, delta, correlation
FROM dr JOIN corr USING (driver) WHERE period = (SELECT period FROM focus)""",
)
def driver_evidence(spark, sf_dir):
    series = full_series(spark, sf_dir)
    return P.driver_evidence(series, SPEC, P.focus_movement(P.movements(series)))


@query(
    "month_range",
    """SELECT period, strftime(CAST(period || '-01' AS DATE), '%Y-%m-%d') AS date_from,
       strftime(last_day(CAST(period || '-01' AS DATE)), '%Y-%m-%d') AS date_to
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders)""",
)
def month_range(spark, sf_dir):
    from movara.functions.dates import month_bounds, month_period

    first, last = month_bounds("period")
    months = table(spark, sf_dir, "orders").select(month_period("o_orderdate").alias("period")).distinct()
    as_text = lambda d: F.date_format(d, "yyyy-MM-dd")
    return months.select("period", as_text(first).alias("date_from"), as_text(last).alias("date_to"))
