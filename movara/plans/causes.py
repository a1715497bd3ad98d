"""Root-cause queries over all months of the sales mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movara.functions.columns import exact_sum, round_to
from movara.functions.labels import movement_severity as severity
from movara.functions.sharing import shared, shared_folder, written
from movara.operators import periods as P
from movara.operators import rootcause as R
from movara.plans import sql as S
from movara.plans.registry import query
from movara.sources.mart import AnalysisSpec, sales_mart

SPEC = AnalysisSpec(date="ship_ts")
CHARTED = ["product_type", "segment"]


def mart(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return sales_mart(spark, sf_dir, "period", "amount", "ship_ts", *SPEC.dimensions, *extra)


def closed_series(spark, sf_dir, supports: bool = False) -> DataFrame:
    if supports:
        rows = sales_mart(spark, sf_dir, "period", "amount", *SPEC.support_columns)
        return shared(P.period_metrics(rows, SPEC))
    return shared(P.monthly_sum(sales_mart(spark, sf_dir, "period", "amount"), "amount"))


def focus_row(spark, sf_dir) -> DataFrame:
    return P.focus_movement(P.movements(closed_series(spark, sf_dir)))


def entity_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Entity movements and the period slots they were placed in."""
    series = closed_series(spark, sf_dir)
    slots = R.period_slots(series, P.focus_movement(P.movements(series)))
    return R.entity_movements(R.entity_periods(mart(spark, sf_dir), SPEC), slots), slots


def top(spark, sf_dir) -> DataFrame:
    return R.contributors(mart(spark, sf_dir), SPEC, series=closed_series(spark, sf_dir))


TOP_COLUMNS = (
    "dimension name position current_value previous_value delta pct share_abs share_total "
    "hist_mean hist_delta concentration recurrence"
).split()


@query("root_cause", S.ROOT + f" SELECT {', '.join(TOP_COLUMNS)} FROM top")
def root_cause(spark, sf_dir):
    return top(spark, sf_dir).select(*TOP_COLUMNS)


@query("impact_ranking", S.ROOT + f" SELECT {', '.join(TOP_COLUMNS)}, impact_rank FROM impact")
def impact_ranking(spark, sf_dir):
    return R.impact_ranking(top(spark, sf_dir)).select(*TOP_COLUMNS, "impact_rank")


_CON = "dimension, name, round(current_value, 2) AS current_value, round(previous_value, 2) AS previous_value, round(delta, 2) AS delta"


_BOTH_MONTHS = """,
e AS (SELECT d.dimension, d.name, period, amount
      FROM m, LATERAL (VALUES ('product_type', product_type), ('segment', segment), ('region', region), ('brand', brand)) AS d(dimension, name)
      WHERE d.name IS NOT NULL AND period IN (SELECT unnest([period, prev_period]) FROM focus)),
con AS (SELECT dimension, name, current_value, previous_value, current_value - previous_value AS delta FROM (
  SELECT dimension, name, coalesce(CAST(sum(amount) FILTER (WHERE period = (SELECT period FROM focus)) AS DOUBLE), 0) AS current_value,
         coalesce(CAST(sum(amount) FILTER (WHERE period = (SELECT prev_period FROM focus)) AS DOUBLE), 0) AS previous_value FROM e GROUP BY ALL))"""


@query("contrib_outer", S.CLOSED + _BOTH_MONTHS + f" SELECT {_CON} FROM con")
def contrib_outer(spark, sf_dir):
    moves, _ = entity_frames(spark, sf_dir)
    figures = [round_to(c, 2).alias(c) for c in ("current_value", "previous_value", "delta")]
    return R.contributions(moves).select("dimension", "name", *figures)


@query(
    "contrib_inner",
    S.ROOT
    + """ SELECT c.name, round(c.value, 4) AS current_value, round(p.value, 4) AS previous_value, round(c.value - p.value, 4) AS delta
FROM cur c JOIN prv p USING (dimension, name) WHERE dimension = 'product_type' ORDER BY abs(c.value - p.value) DESC, c.name LIMIT 3""",
)
def contrib_inner(spark, sf_dir):
    rows = sales_mart(spark, sf_dir, "period", "amount", "ship_ts", "product_type")
    return R.quick_evidence(rows, SPEC, focus_row(spark, sf_dir))


@query(
    "contrib_history",
    S.ROOT
    + """ SELECT c.dimension, c.name, round(c.current_value, 2) AS current_value, round(h.hist_mean, 2) AS hist_mean,
       round(c.current_value - h.hist_mean, 2) AS hist_delta FROM con c LEFT JOIN hist h USING (dimension, name)""",
)
def contrib_history(spark, sf_dir):
    moves, _ = entity_frames(spark, sf_dir)
    rows = R.contributions(moves).withColumn("hist_delta", F.col("current_value") - F.col("hist_mean"))
    return rows.select(
        "dimension", "name", *[round_to(c, 2).alias(c) for c in ("current_value", "hist_mean", "hist_delta")]
    )


@query(
    "entity_history_mean", S.ROOT + " SELECT dimension, name, round(hist_mean, 2) AS hist_mean FROM hist"
)
def entity_history_mean(spark, sf_dir):
    entities = R.entity_periods(mart(spark, sf_dir), SPEC)
    return entities.groupBy("dimension", "name").agg(round_to(exact_sum("value") / F.count("value"), 2).alias("hist_mean"))


@query(
    "dense_grid",
    S.ROOT + " SELECT dimension, name, CAST(slot AS BIGINT) AS slot, round(value, 2) AS value FROM grid",
)
def dense_grid(spark, sf_dir):
    moves, slots = entity_frames(spark, sf_dir)
    wide = moves.select("dimension", "name", *[F.col(f"v{i}").alias(str(i)) for i in range(4)])
    long = wide.unpivot(["dimension", "name"], [str(i) for i in range(4)], "slot", "value")
    kept = long.withColumn("slot", F.col("slot").cast("bigint")).join(slots, "slot", "left_semi")
    return kept.select("dimension", "name", "slot", round_to("value", 2).alias("value"))


@query(
    "recurrence",
    S.ROOT
    + """ SELECT n.dimension, n.name, CASE WHEN coalesce(r.appearances, 0) >= 2 THEN 'recurrent' ELSE 'one_off' END AS recurrence
FROM names n LEFT JOIN rec r USING (dimension, name)""",
)
def recurrence(spark, sf_dir):
    moves, slots = entity_frames(spark, sf_dir)
    flagged = moves.select("dimension", "name").join(R.recurrence(moves, slots), ["dimension", "name"], "left")
    label = F.when(F.col("appearances").isNotNull(), "recurrent").otherwise("one_off")
    return flagged.select("dimension", "name", label.alias("recurrence"))


@query(
    "contrib_share",
    S.ROOT
    + """ SELECT c.dimension, c.name, round(abs(c.delta) / t.abs_total, 6) AS share_abs,
       round(c.delta / (SELECT delta FROM focus), 6) AS share_total FROM con c JOIN tot t USING (dimension)""",
)
def contrib_share(spark, sf_dir):
    moves, _ = entity_frames(spark, sf_dir)
    contributed = R.contributions(moves)
    total = focus_row(spark, sf_dir).select("delta").scalar()
    rows = contributed.join(R.dimension_totals(contributed), "dimension")
    return rows.select(
        "dimension",
        "name",
        round_to(F.abs("delta") / F.col("abs_total"), 6).alias("share_abs"),
        round_to(F.try_divide(F.col("delta"), total), 6).alias("share_total"),
    )


@query(
    "entity_union",
    S.ROOT + " SELECT dimension, name FROM cur UNION SELECT dimension, name FROM prv",
)
def entity_union(spark, sf_dir):
    moves, _ = entity_frames(spark, sf_dir)
    return R.contributions(moves).select("dimension", "name")


_PAIRS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS name, '{o}' AS related, {o} AS related_name, amount FROM m "
    f"WHERE period = (SELECT period FROM focus)"
    for d in S.DIMENSIONS
    for o in [x for x in S.DIMENSIONS if x != d][:3]
)
CONTEXT = f""", pr AS ({_PAIRS}),
pt AS (SELECT dimension, name, related, related_name, CAST(sum(amount) AS DOUBLE) AS value FROM pr
       JOIN top USING (dimension, name) WHERE related_name IS NOT NULL GROUP BY ALL),
ctx AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY dimension, name, related ORDER BY value DESC, related_name) = 1),
ctxt AS (SELECT dimension, name, string_agg(related || ': ' || related_name, ' | ' ORDER BY
         {S.DIM_ORDER.replace("CASE dimension", "CASE related")}) AS context FROM ctx GROUP BY ALL)"""


@query(
    "contrib_context",
    S.ROOT + CONTEXT + " SELECT dimension, name, related, related_name, round(value, 2) AS value FROM ctx",
)
def contrib_context(spark, sf_dir):
    rows = mart(spark, sf_dir)
    context = R.contributor_context(rows, SPEC, R.contributors(rows, SPEC), focus_row(spark, sf_dir))
    return context.select("dimension", "name", "related", "related_name", round_to("value", 2).alias("value"))


CONCENTRATION = """, conc AS (SELECT dimension, round(sum(CASE WHEN position <= 1 THEN share_abs ELSE 0 END), 4) AS top_1,
  round(sum(CASE WHEN position <= 3 THEN share_abs ELSE 0 END), 4) AS top_3,
  round(sum(CASE WHEN position <= 5 THEN share_abs ELSE 0 END), 4) AS coverage FROM top GROUP BY dimension)"""


@query("concentration", S.ROOT + CONCENTRATION + " SELECT * FROM conc")
def concentration(spark, sf_dir):
    return R.concentration(top(spark, sf_dir))


FLAGS = ("line_status", "return_flag", "order_status")


#: Flags of a line, and whether it is a bulk line: few names, so that one of them carries most of a movement.
ALERTED = (*FLAGS, "size_class")
_SIZE_CLASS = "CASE WHEN l_quantity >= 45 THEN 'bulk' ELSE 'regular' END AS size_class"


@query(
    "concentration_alerts",
    S.root(ALERTED).replace("r_name AS region", f"r_name AS region, {_SIZE_CLASS}", 1)
    + " SELECT dimension, name, share_abs, concentration AS level FROM top WHERE position = 1 AND share_abs >= 0.6",
)
def concentration_alerts(spark, sf_dir):
    rows = sales_mart(spark, sf_dir, "period", "amount", "quantity", *FLAGS)
    classed = rows.withColumn("size_class", F.when(F.col("quantity") >= 45, "bulk").otherwise("regular"))
    return R.concentration_alerts(R.contributors(classed, AnalysisSpec(dimensions=ALERTED)))


LEADS = """, leads AS (SELECT dimension, name, share_abs, recurrence, concentration, hist_mean, hist_delta,
  round(hist_delta / nullif(abs(hist_mean), 0), 4) AS hist_delta_pct,
  CASE WHEN share_abs >= 0.8 THEN 'high' WHEN share_abs >= 0.6 OR recurrence = 'recurrent' THEN 'medium' ELSE 'low' END AS priority
  FROM top WHERE position = 1)"""


@query(
    "dimension_priority",
    S.ROOT + LEADS + " SELECT dimension, name, share_abs, recurrence, concentration, priority FROM leads",
)
def dimension_priority(spark, sf_dir):
    leads = R.dimension_leads(top(spark, sf_dir))
    return leads.select("dimension", "name", "share_abs", "recurrence", "concentration", "priority")


@query(
    "history_gap",
    S.ROOT + LEADS + " SELECT dimension, name, hist_mean, hist_delta, hist_delta_pct FROM leads",
)
def history_gap(spark, sf_dir):
    leads = R.dimension_leads(top(spark, sf_dir))
    return leads.select("dimension", "name", "hist_mean", "hist_delta", "hist_delta_pct")


WATERFALL = """, bars AS (SELECT * FROM top WHERE position <= 5 AND dimension = (SELECT arg_min(dimension, """ + S.DIM_ORDER + """) FROM top)),
reach AS (SELECT (SELECT value - prev_value FROM focus) - coalesce(sum(delta), 0) AS delta FROM bars),
wf AS (
  SELECT 0 AS step, prev_period AS label, 'baseline' AS kind, CAST(NULL AS DOUBLE) AS delta, prev_value AS running_total FROM focus
  UNION ALL SELECT position, name, CASE WHEN delta >= 0 THEN 'increase' ELSE 'decrease' END, delta,
    (SELECT prev_value FROM focus) + sum(delta) OVER (ORDER BY position) FROM bars
  UNION ALL SELECT 6, 'other_effects', CASE WHEN delta >= 0 THEN 'increase' ELSE 'decrease' END, delta, (SELECT value FROM focus)
    FROM reach WHERE abs(delta) >= greatest(abs((SELECT value FROM focus)) * 0.01, 0.01)
  UNION ALL SELECT 7, period, 'current', NULL, value FROM focus
)"""


@query(
    "waterfall",
    S.ROOT
    + WATERFALL
    + " SELECT CAST(step AS BIGINT) AS step, label, kind, round(delta, 2) AS delta, round(running_total, 2) AS running_total FROM wf",
)
def waterfall(spark, sf_dir):
    steps = R.waterfall(top(spark, sf_dir), SPEC, focus_row(spark, sf_dir))
    return steps.select(
        "step", "label", "kind", round_to("delta", 2).alias("delta"), round_to("running_total", 2).alias("running_total")
    )


_ALERT_ABNORMAL = """, cut AS (SELECT coalesce(greatest(quantile_cont(abs(pct), 0.8), 0.25), 0.25) AS threshold FROM v WHERE delta IS NOT NULL),
ab AS (SELECT count(*) AS n FROM v, cut WHERE delta IS NOT NULL AND (abs(pct) >= threshold OR coalesce(abs(zscore), 0) >= 2)),
sl AS (SELECT period, discount - lag(discount) OVER (ORDER BY period) AS dd, quantity - lag(quantity) OVER (ORDER BY period) AS dq FROM s),
alerts AS (
  SELECT 'abnormal_periods' AS alert, CAST(NULL AS VARCHAR) AS subject, CAST(n AS DOUBLE) AS measure FROM ab WHERE n > 0
  UNION ALL SELECT 'critical_movement', period, pct FROM focus WHERE abs(pct) >= 0.5
  UNION ALL SELECT CASE WHEN pct < 0 THEN 'large_drop' ELSE 'large_rise' END, period, pct FROM focus WHERE abs(pct) >= 0.5
  UNION ALL SELECT 'cost_up_volume_down', period, dd FROM sl WHERE period = (SELECT period FROM focus) AND dd > 0 AND dq < 0
  UNION ALL SELECT 'dominant_contributor', dimension || ': ' || name, share_abs FROM impact WHERE impact_rank = 1 AND share_abs >= 0.8
  UNION ALL SELECT 'concentration_' || concentration, dimension || ': ' || name, share_abs FROM top WHERE position = 1 AND share_abs >= 0.6
)"""


@query(
    "movement_alerts",
    S.ROOT + _ALERT_ABNORMAL + " SELECT alert, subject, round(measure, 4) AS measure FROM alerts",
)
def movement_alerts(spark, sf_dir):
    series = closed_series(spark, sf_dir, supports=True)
    return R.movement_alerts(series, SPEC, top(spark, sf_dir), cost="discount", volume="quantity")


CONFIDENCE = """, cf AS (SELECT count(*) AS n, (SELECT arg_min(coverage, """ + S.DIM_ORDER + """) FROM conc) AS coverage FROM conc),
sc AS (
  SELECT 'root_cause' AS scope, (n > 0)::INT + 1 + coalesce(coverage >= 0.75, FALSE)::INT AS score FROM cf
  UNION ALL SELECT 'focus_insight', 1 + 1 + (n > 0)::INT + (SELECT (pct IS NOT NULL)::INT FROM focus) FROM cf
),
conf AS (SELECT scope, CAST(score AS BIGINT) AS score, CASE WHEN scope = 'root_cause' THEN
  CASE WHEN score >= 3 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END END AS level FROM sc)"""


@query("confidence", S.ROOT + CONCENTRATION + CONFIDENCE + " SELECT * FROM conf")
def confidence(spark, sf_dir):
    series = closed_series(spark, sf_dir, supports=True)
    focus = P.focus_movement(P.movements(series))
    return R.confidence_levels(top(spark, sf_dir), focus, P.driver_evidence(series, SPEC, focus), SPEC)


# ---- exports -------------------------------------------------------------

_MONTHLY = """, tail AS (SELECT v.*, row_number() OVER (ORDER BY period DESC) AS age FROM v QUALIFY age <= 18),
dr0 AS (
  SELECT period, 'quantity' AS driver, 0 AS o, quantity AS cur, lag(quantity) OVER (ORDER BY period) AS prv FROM s
  UNION ALL SELECT period, 'discount', 1, discount, lag(discount) OVER (ORDER BY period) FROM s
  UNION ALL SELECT period, 'margin_rate', 2, margin_rate, lag(margin_rate) OVER (ORDER BY period) FROM s
),
dr1 AS (SELECT period, driver, o, round(cur - prv, 4) AS d, round((cur - prv) / nullif(abs(prv), 0), 4) AS p FROM dr0 WHERE prv IS NOT NULL),
dr AS (SELECT * FROM dr1 QUALIFY row_number() OVER (PARTITION BY period ORDER BY greatest(abs(coalesce(p, 0)), abs(d) / 1000) DESC, o) = 1)
SELECT t.period, CAST(substr(t.period, 1, 4) AS INTEGER) AS year, CAST(substr(t.period, 6, 2) AS INTEGER) AS month,
       round(value, 2) AS value, round(prev_value, 2) AS prev_value, round(delta, 2) AS delta, round(pct, 4) AS pct,
       round(avg(value) OVER (ORDER BY t.period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg,
       round(sum(value) OVER (PARTITION BY substr(t.period, 1, 4) ORDER BY t.period), 2) AS ytd,
       round(hist_mean, 2) AS hist_mean, round(zscore, 4) AS zscore, """ + S.STATUS + """ AS status,
       dr.driver AS main_driver, dr.d AS driver_delta, dr.p AS driver_pct
FROM tail t LEFT JOIN dr ON dr.period = t.period"""


@query("export_monthly", S.CLOSED + _MONTHLY)
def export_monthly(spark, sf_dir):
    from movara.operators.export import monthly_rows

    return monthly_rows(closed_series(spark, sf_dir, supports=True), SPEC)


@query("export_bi", S.CLOSED + _MONTHLY)
def export_bi(spark, sf_dir):
    """The monthly table written for a BI tool as headed CSV, and read again."""
    from movara.operators.export import monthly_rows, write_tables

    rows = monthly_rows(closed_series(spark, sf_dir, supports=True), SPEC)
    folder = shared_folder(spark, "bi")
    write_tables({"monthly": rows}, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/monthly")


SEVERITY = """CASE WHEN abs(coalesce(pct, 0)) >= 0.5 THEN 'critical' WHEN abs(coalesce(pct, 0)) >= 0.25 THEN 'relevant'
       WHEN abs(delta) > 0 THEN 'moderate' ELSE 'stable' END"""


@query("movement_severity", S.SERIES + f" SELECT period, round(delta, 2) AS delta, {SEVERITY} AS severity FROM v")
def movement_severity(spark, sf_dir):
    moved = P.movements(closed_series(spark, sf_dir))
    return moved.select("period", round_to("delta", 2).alias("delta"), severity("delta", "pct").alias("severity"))


@query(
    "focus_summary",
    S.CLOSED
    + """ SELECT period, prev_period, CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END AS direction,
       round(value, 2) AS value, round(delta, 2) AS delta, round(pct, 4) AS pct, round(value - hist_mean, 2) AS hist_delta FROM focus""",
)
def focus_summary(spark, sf_dir):
    summary = R.focus_summary(focus_row(spark, sf_dir))
    figures = [round_to(c, 2).alias(c) for c in ("value", "delta", "hist_delta")]
    return summary.select("period", "prev_period", "direction", *figures, "pct")


@query(
    "export_root_cause",
    S.ROOT
    + WATERFALL
    + CONTEXT
    + """ SELECT 'contributor' AS row_type, f.period, f.prev_period, t.dimension, t.name AS entity, t.current_value, t.previous_value,
       t.delta, t.pct, t.share_abs, t.share_total, t.hist_mean, t.hist_delta, t.concentration, t.recurrence, c.context, CAST(NULL AS BIGINT) AS step
FROM top t CROSS JOIN focus f LEFT JOIN ctxt c ON c.dimension = t.dimension AND c.name = t.name
UNION ALL SELECT 'waterfall', f.period, f.prev_period, (SELECT arg_min(dimension, """ + S.DIM_ORDER + """) FROM top), w.label, round(w.running_total, 4),
       NULL, round(w.delta, 4), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(w.step AS BIGINT) FROM wf w CROSS JOIN focus f""",
)
def export_root_cause(spark, sf_dir):
    from movara.operators.export import root_cause_rows

    return root_cause_rows(mart(spark, sf_dir), SPEC)


@query(
    "export_dimension",
    S.ROOT
    + CONTEXT
    + CONCENTRATION
    + LEADS
    + """, mov AS (SELECT dimension, string_agg(name, ' | ' ORDER BY position) AS main_movers FROM top WHERE position <= 3 GROUP BY 1)
SELECT l.dimension, mov.main_movers, l.priority, conc.top_1, conc.top_3, l.concentration AS level, l.hist_mean, l.hist_delta, c.context
FROM leads l JOIN conc USING (dimension) JOIN mov USING (dimension) LEFT JOIN ctxt c ON c.dimension = l.dimension AND c.name = l.name""",
)
def export_dimension(spark, sf_dir):
    from movara.operators.export import dimension_rows

    return dimension_rows(mart(spark, sf_dir), SPEC)


@query(
    "export_charts",
    S.CLOSED
    + """ SELECT 'monthly' AS chart, 'line' AS type, period AS x, round(value, 2) AS y, row_number() OVER (ORDER BY period) AS point, CAST(1 AS BIGINT) AS chart_order FROM v
UNION ALL SELECT 'ranking_product_type', 'bar', x, y, row_number() OVER (ORDER BY y DESC, x), 2 FROM
  (SELECT product_type AS x, CAST(sum(amount) AS DOUBLE) AS y FROM m GROUP BY 1 ORDER BY y DESC, x LIMIT 8)
UNION ALL SELECT 'ranking_segment', 'bar', x, y, row_number() OVER (ORDER BY y DESC, x), 3 FROM
  (SELECT segment AS x, CAST(sum(amount) AS DOUBLE) AS y FROM m GROUP BY 1 ORDER BY y DESC, x LIMIT 8)""",
)
def export_charts(spark, sf_dir):
    from movara.operators.export import chart_rows

    return chart_rows(mart(spark, sf_dir), SPEC, CHARTED)


@query(
    "report_facts",
    """WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem),
s AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, sum(CAST(l_quantity AS DECIMAL(18,2))) AS v FROM d WHERE l_quantity IS NOT NULL GROUP BY 1)
(SELECT 'peak_point' AS fact, period AS subject, CAST(v AS DOUBLE) AS value FROM s ORDER BY v DESC, period LIMIT 1)
UNION ALL SELECT 'first_numeric_total', 'l_orderkey', CAST(sum(l_orderkey) AS DOUBLE) FROM d
UNION ALL SELECT 'worst_missing', 'l_quantity', CAST(count(*) - count(l_quantity) AS DOUBLE) FROM d
UNION ALL SELECT 'duplicates', NULL, CAST((SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS DOUBLE)""",
)
def report_facts(spark, sf_dir):
    from movara.operators.export import report_facts as facts
    from movara.sources.mart import table

    quantity = F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", quantity.alias("l_quantity")
    )
    return facts(rows, "l_shipdate", "l_quantity", "l_orderkey")


@query(
    "export_indicators",
    S.ROOT
    + """, ok AS (SELECT * FROM v WHERE delta IS NOT NULL),
r AS (SELECT value, row_number() OVER (ORDER BY period DESC) AS age FROM v),
i AS (
  SELECT 'metric' AS indicator, 'amount' AS value, CAST(NULL AS DOUBLE) AS measure
  UNION ALL (SELECT 'latest_period', period, round(delta, 2) FROM ok ORDER BY period DESC LIMIT 1)
  UNION ALL (SELECT 'largest_rise', period, round(delta, 2) FROM ok ORDER BY delta DESC, period LIMIT 1)
  UNION ALL (SELECT 'largest_drop', period, round(delta, 2) FROM ok ORDER BY delta, period LIMIT 1)
  UNION ALL (SELECT 'best_month', period, round(value, 2) FROM v ORDER BY value DESC, period LIMIT 1)
  UNION ALL (SELECT 'worst_month', period, round(value, 2) FROM v ORDER BY value, period LIMIT 1)
  UNION ALL SELECT 'last_3_months', NULL, round(sum(value), 2) FROM r WHERE age <= 3
  UNION ALL SELECT 'lead_' || dimension, name, share_abs FROM top WHERE position = 1
  UNION ALL (SELECT 'main_contributor', name, share_abs FROM top WHERE position = 1 ORDER BY """ + S.DIM_ORDER + """ LIMIT 1)
) SELECT * FROM i""",
)
def export_indicators(spark, sf_dir):
    from movara.operators.export import indicator_rows

    return indicator_rows(closed_series(spark, sf_dir), top(spark, sf_dir), SPEC)


@query("evidence_bundle")
def evidence_bundle(spark, sf_dir):
    from movara.operators.export import evidence_bundle as bundle

    return bundle(closed_series(spark, sf_dir, supports=True), top(spark, sf_dir), SPEC)


def _evidence_sql() -> str:
    """The lists of the bundle, one row an entry, from the twins of what they are made of."""
    from movara.plans import periods  # noqa: F401 - registers the twin of the drivers
    from movara.plans.registry import ORACLES

    moves = "period AS name, round(value, 4) AS first, round(delta, 4) AS second, round(zscore, 4) AS third"
    return f"""SELECT 'movements' AS list, row_number() OVER (ORDER BY name) AS position, * FROM (
  {S.CLOSED} SELECT {moves} FROM v WHERE delta IS NOT NULL ORDER BY period DESC LIMIT 12)
UNION ALL SELECT 'abnormal', place, name, first, second, third FROM (
  {S.CLOSED}, cut AS (SELECT coalesce(greatest(quantile_cont(abs(pct), 0.8), 0.25), 0.25) AS threshold FROM v WHERE delta IS NOT NULL)
  SELECT {moves}, row_number() OVER (ORDER BY abs(delta) DESC, period) AS place FROM v, cut
  WHERE delta IS NOT NULL AND (abs(pct) >= threshold OR coalesce(abs(zscore), 0) >= 2)) WHERE place <= 8
UNION ALL SELECT 'drivers', row_number() OVER (ORDER BY abs(coalesce(correlation, 0)) DESC, driver), driver, current_value, delta, correlation FROM ({ORACLES["driver_evidence"]})
UNION ALL SELECT 'impact', impact_rank, dimension || ': ' || name, delta, share_abs, NULL FROM ({ORACLES["impact_ranking"]}) WHERE impact_rank <= 8"""


@query("evidence_items", _evidence_sql())
def evidence_items(spark, sf_dir):
    """The evidence bundle read back from its one JSON document, one row an entry of its lists."""
    entry = "period string, value double, delta double, zscore double, driver string, current_value double, correlation double, dimension string, name string, share_abs double"
    lists = ("movements", "abnormal", "drivers", "impact")
    schema = ", ".join(f"{n} array<struct<{', '.join(f'{p.split()[0]}: {p.split()[1]}' for p in entry.split(', '))}>>" for n in lists)
    read = evidence_bundle(spark, sf_dir).select(F.from_json("evidence", schema).alias("e"))
    rows = []
    for name in lists:
        third = {"drivers": "correlation", "impact": None}.get(name, "zscore")
        item = lambda c: F.col(f"item.{c}")
        named = {"drivers": item("driver"), "impact": F.concat_ws(": ", item("dimension"), item("name"))}.get(name, item("period"))
        first = {"drivers": "current_value", "impact": "delta"}.get(name, "value")
        second = {"impact": "share_abs"}.get(name, "delta")
        rows.append(
            read.select(F.posexplode(f"e.{name}").alias("at", "item")).select(
                F.lit(name).alias("list"), (F.col("at") + 1).cast("long").alias("position"), named.alias("name"), item(first).alias("first"),
                item(second).alias("second"), item(third).alias("third") if third else F.lit(None).cast("double").alias("third"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


#: Tables of the package with a figure to add up.
_PACKAGE = {"monthly": "value", "root_cause": "delta", "dimension": "top_1", "indicators": "measure", "charts": "y"}


def _package_sql() -> str:
    from movara.plans.registry import ORACLES

    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", count(*) AS rows, count(*) AS manifest_rows, round(sum({figure}), 2) AS total FROM ({ORACLES["export_" + name]})"""
        for name, figure in _PACKAGE.items()
    )


@query("export_package", _package_sql())
def export_package(spark, sf_dir):
    """All result tables of an analysis delivered as one package and read back by its manifest; the lookups are joined once for all of them."""
    from movara.operators import export as E

    rows, series = written(mart(spark, sf_dir), "mart"), closed_series(spark, sf_dir)
    made = {
        "monthly": export_monthly(spark, sf_dir),
        "root_cause": E.root_cause_rows(rows, SPEC),
        "dimension": E.dimension_rows(rows, SPEC),
        "indicators": E.indicator_rows(series, R.contributors(rows, SPEC, series=series), SPEC),
        "charts": E.chart_rows(rows, SPEC, CHARTED),
    }
    folder = shared_folder(spark, "package")
    about = {"metric": SPEC.metric, "dimensions": ", ".join(SPEC.dimensions)}
    E.write_package(made, folder, {"monthly": ["year"], "charts": ["chart"]}, about)
    tables = E.read_package(spark, folder)
    known = tables["manifest"].select("table", F.col("rows").alias("manifest_rows"))
    sums = [
        tables[n].agg(F.lit(n).alias("table"), F.count("*").alias("rows"), round_to(F.sum(figure), 2).alias("total")) for n, figure in _PACKAGE.items()
    ]
    return reduce(DataFrame.unionByName, sums).join(known, "table")
