"""Ranking, totals, facets and filter queries over the sales mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from movara.functions.columns import round_to
from movara.operators import filters as P
from movara.operators import periods, rank, stats
from movara.plans import sql as S
from movara.plans.registry import query
from movara.sources.mart import sales_mart, table

M = S.ctes(S.MART)
DIMS = list(S.DIMENSIONS)


def _top(name: str, column: str, ascending: bool) -> None:
    way = "ASC" if ascending else "DESC"

    @query(
        name,
        M
        + f""" SELECT {column} AS name, CAST(sum(amount) AS DOUBLE) AS total FROM m
WHERE {column} IS NOT NULL AND amount IS NOT NULL GROUP BY 1 ORDER BY total {way}, name LIMIT 5""",
    )
    def run(spark, sf_dir):
        return rank.rank_by_sum(sales_mart(spark, sf_dir, column, "amount"), column, "amount", 5, ascending)


_top("rank_sum_desc", "brand", False)
_top("rank_sum_asc", "brand", True)


@query(
    "rank_count",
    M + " SELECT segment AS name, count(*) AS records FROM m GROUP BY 1 ORDER BY records DESC, name LIMIT 5",
)
def rank_count(spark, sf_dir):
    return rank.rank_by_count(sales_mart(spark, sf_dir, "segment"), "segment")


@query("metric_total", M + " SELECT CAST(sum(amount) AS DOUBLE) AS total FROM m")
def metric_total(spark, sf_dir):
    return rank.metric_totals(sales_mart(spark, sf_dir, "amount"), "amount").select("total")


@query("metric_mean", M + " SELECT round(CAST(sum(amount) AS DOUBLE) / count(amount), 4) AS mean FROM m")
def metric_mean(spark, sf_dir):
    totals = rank.metric_totals(sales_mart(spark, sf_dir, "amount"), "amount")
    return totals.select(round_to("mean").alias("mean"))


@query(
    "distinct_count",
    M
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM m"
        for c in ("product", "brand", "customer", "supplier")
    ),
)
def distinct_count(spark, sf_dir):
    columns = ("product", "brand", "customer", "supplier")
    return rank.distinct_values(sales_mart(spark, sf_dir, *columns), *columns)


@query(
    "rank_top8_share",
    M
    + """, t AS (SELECT brand AS name, CAST(sum(amount) AS DOUBLE) AS total FROM m GROUP BY 1 ORDER BY total DESC, name LIMIT 8)
SELECT row_number() OVER (ORDER BY total DESC, name) AS position, name, total,
       round(abs(total) / sum(abs(total)) OVER (), 6) AS share FROM t""",
)
def rank_top8_share(spark, sf_dir):
    rows = rank.rank_with_share(sales_mart(spark, sf_dir, "brand", "amount"), "brand", "amount")
    return rows.select(F.col("position").cast("bigint").alias("position"), "name", "total", round_to("share", 6).alias("share"))


@query(
    "rank_margin_mean",
    M
    + """ SELECT product AS name, round(avg(margin_rate), 6) AS mean FROM m
GROUP BY 1 ORDER BY mean DESC, name LIMIT 8""",
)
def rank_margin_mean(spark, sf_dir):
    return rank.rank_by_mean(sales_mart(spark, sf_dir, "product", "margin_rate"), "product", "margin_rate")


@query(
    "facet_counts",
    M
    + ", f AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS name, count(*) AS records FROM m GROUP BY {d}" for d in DIMS)
    + """) SELECT dimension, name, records, row_number() OVER (PARTITION BY dimension ORDER BY records DESC, name) AS position
FROM f QUALIFY position <= 10""",
)
def facet_counts(spark, sf_dir):
    rows = rank.facet_counts(sales_mart(spark, sf_dir, *DIMS), DIMS)
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query(
    "report_bar10",
    M
    + """, b AS (SELECT 'bar' AS chart, supplier AS label, CAST(sum(amount) AS DOUBLE) AS value FROM m GROUP BY 2 ORDER BY value DESC, label LIMIT 10),
l AS (SELECT 'line' AS chart, period AS label, CAST(sum(amount) AS DOUBLE) AS value FROM m GROUP BY 2 ORDER BY label LIMIT 24)
SELECT * FROM b UNION ALL SELECT * FROM l""",
)
def report_bar10(spark, sf_dir):
    bars = rank.rank_by_sum(sales_mart(spark, sf_dir, "supplier", "amount"), "supplier", "amount", 10)
    line = periods.monthly_sum(sales_mart(spark, sf_dir, "period", "amount"), "amount").orderBy("period").limit(24)
    return bars.select(F.lit("bar").alias("chart"), F.col("name").alias("label"), F.col("total").alias("value")).unionByName(
        line.select(F.lit("line").alias("chart"), F.col("period").alias("label"), "value")
    )


@query(
    "pie_share",
    """WITH t AS (SELECT c_mktsegment AS name, CAST(sum(CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_acctbal AS DECIMAL(18,2))
         ELSE -CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM customer GROUP BY 1),
p AS (SELECT * FROM t ORDER BY total DESC, name LIMIT 8)
SELECT name, total, round(greatest(total, 0) / nullif(sum(greatest(total, 0)) OVER (), 0), 6) AS share FROM p""",
)
def pie_share(spark, sf_dir):
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    signed = F.when(F.col("c_nationkey") % 2 == 0, balance).otherwise(-balance)
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), signed.alias("balance"))
    slices = rank.pie_slices(rank.totals_by(rows, "segment", "balance"))
    return slices.select("name", "total", round_to("share", 6).alias("share"))


@query(
    "bars_by_size",
    """SELECT c_nationkey || '' AS name, CAST(sum(CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_acctbal AS DECIMAL(18,2))
         ELSE -CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM customer GROUP BY 1 ORDER BY abs(total) DESC, name LIMIT 10""",
)
def bars_by_size(spark, sf_dir):
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    signed = F.when(F.col("c_nationkey") % 2 == 0, balance).otherwise(-balance)
    rows = table(spark, sf_dir, "customer").select("c_nationkey", signed.alias("balance"))
    return rank.bars_by_size(rank.totals_by(rows, "c_nationkey", "balance"))


@query(
    "dedupe_norm",
    """WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents
),
k AS (
  SELECT doc_id, line_no, line,
         trim(regexp_replace(regexp_replace(lower(strip_accents(line)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS key
  FROM l WHERE trim(line) <> ''
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM k
QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, line_no) = 1""",
)
def dedupe_norm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = rank.first_by_text(lines, "line", "doc_id", "line_no")
    return kept.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(
    "filter_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-09-30'""",
)
def filter_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(P.date_range("o_orderdate", "1997-03-01", "1997-09-30"))
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


@query(
    "filter_date_midnight",
    """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'""",
)
def filter_date_midnight(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.where(P.date_range("ts", "2024-01-05", "2024-01-12")).select("event_id")


_CHOSEN = {"segment": ["BUILDING", "MACHINERY", " "], "region": ["ASIA"], "unknown": ["x"], "brand": []}
_CHOSEN_SQL = "segment IN ('BUILDING', 'MACHINERY') AND region IN ('ASIA')"


@query(
    "filter_category",
    M
    + f""" SELECT period, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS records FROM m
WHERE {_CHOSEN_SQL} GROUP BY period""",
)
def filter_category(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "period", "amount", "segment", "region")
    rows = mart.where(P.categories(mart, _CHOSEN))
    return rows.groupBy("period").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("records"))


@query(
    "filter_report",
    M
    + f""" SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_CHOSEN_SQL} AND ship_ts >= TIMESTAMP '1999-01-01'
       AND ship_ts <= TIMESTAMP '2000-12-31') AS rows_after, CAST(2 AS BIGINT) AS filters_applied FROM m""",
)
def filter_report(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "ship_ts", "segment", "region")
    return P.filter_report(mart, P.categories(mart, _CHOSEN), P.date_range("ship_ts", "1999-01-01", "2000-12-31"))


@query(
    "drilldown_month",
    M
    + """ SELECT segment AS name, CAST(sum(amount) AS DOUBLE) AS total FROM m
WHERE ship_ts >= TIMESTAMP '1999-02-01' AND ship_ts <= TIMESTAMP '1999-02-28' GROUP BY 1 ORDER BY total DESC, name LIMIT 8""",
)
def drilldown_month(spark, sf_dir):
    mart = sales_mart(spark, sf_dir, "ship_ts", "amount", "segment")
    return rank.rank_by_sum(mart.where(P.month_filter("ship_ts", "1999-02")), "segment", "amount", 8)


@query(
    "semi_filter",
    M
    + """ SELECT brand AS name, CAST(sum(amount) AS DOUBLE) AS total FROM m
WHERE brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25) GROUP BY 1""",
)
def semi_filter(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("s")).where("s > 25")
    rows = P.in_listed(sales_mart(spark, sf_dir, "brand", "amount"), "brand", chosen.select("p_brand"))
    return rank.totals_by(rows, "brand", "amount")


@query(
    "chart_alert",
    M
    + """, b AS (SELECT 'ranking' AS chart, max(t) / sum(t) AS top_share, CAST(NULL AS DOUBLE) AS last_move
  FROM (SELECT abs(CAST(sum(amount) AS DOUBLE)) AS t FROM m GROUP BY segment)),
s AS (SELECT period, CAST(sum(amount) AS DOUBLE) AS value FROM m GROUP BY period),
w AS (SELECT *, lag(value) OVER (ORDER BY period) AS prev FROM s),
l AS (SELECT 'monthly' AS chart, (SELECT max(abs(value)) / sum(abs(value)) FROM s) AS top_share,
   (value - prev) / abs(prev) AS last_move FROM w ORDER BY period DESC LIMIT 1),
a AS (SELECT * FROM b UNION ALL SELECT * FROM l)
SELECT chart, round(top_share, 4) AS top_share, round(last_move, 4) AS last_move,
       CASE WHEN top_share >= 0.8 THEN 'high_concentration' WHEN abs(last_move) >= 0.5 THEN 'strong_movement' ELSE 'none' END AS alert
FROM a""",
)
def chart_alert(spark, sf_dir):
    from movara.operators.dashboard import chart_alerts

    bars = rank.totals_by(sales_mart(spark, sf_dir, "segment", "amount"), "segment", "amount")
    series = periods.monthly_sum(sales_mart(spark, sf_dir, "period", "amount"), "amount")
    return chart_alerts(bars, series)


@query("shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape(spark, sf_dir):
    return stats.shape(table(spark, sf_dir, "lineitem"))


@query(
    "preview",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50",
)
def preview(spark, sf_dir):
    from movara.operators.dashboard import preview as head

    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return head(table(spark, sf_dir, "lineitem").select(*columns), 80, columns)


@query(
    "date_span",
    """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
       count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders""",
)
def date_span(spark, sf_dir):
    return stats.date_span(table(spark, sf_dir, "orders"), "o_orderdate")
