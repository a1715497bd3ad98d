"""Shared SQL building blocks of the oracle statements."""

from __future__ import annotations

MART = """m AS (
  SELECT l_orderkey AS order_id, l_shipdate AS ship_ts, strftime(l_shipdate, '%Y-%m') AS period,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_quantity AS quantity,
         l_discount AS discount, l_tax AS tax, 1 - l_discount AS margin_rate,
         l_returnflag AS return_flag, l_linestatus AS line_status,
         p_type AS product_type, p_brand AS brand, p_name AS product, s_name AS supplier,
         o_orderstatus AS order_status, o_orderpriority AS priority,
         c_mktsegment AS segment, c_name AS customer, n_name AS nation, r_name AS region
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def series(source: str = "m", name: str = "s") -> str:
    return f"""{name} AS (
  SELECT period, CAST(sum(amount) AS DOUBLE) AS value, sum(quantity) AS quantity,
         avg(discount) AS discount, avg(margin_rate) AS margin_rate
  FROM {source} WHERE period IS NOT NULL AND amount IS NOT NULL GROUP BY period
)"""


def moves(source: str = "s", name: str = "v") -> str:
    return f"""{name}0 AS (
  SELECT *, lag(period) OVER (ORDER BY period) AS prev_period,
         lag(value) OVER (ORDER BY period) AS prev_value,
         count(*) OVER e AS seen, CAST(sum(CAST(value AS DECIMAL(38,10))) OVER e AS DOUBLE) / nullif(count(*) OVER e, 0) AS all_mean, stddev_samp(value) OVER e AS all_std
  FROM {source}
  WINDOW e AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name} AS (
  SELECT period, prev_period, value, prev_value, value - prev_value AS delta,
         (value - prev_value) / nullif(prev_value, 0) AS pct,
         CASE WHEN seen >= 2 THEN all_mean END AS hist_mean,
         CASE WHEN seen >= 3 THEN all_std END AS hist_std,
         CASE WHEN seen >= 3 THEN (value - all_mean) / nullif(all_std, 0) END AS zscore
  FROM {name}0
)"""


STATUS = """CASE WHEN delta IS NULL THEN 'base' WHEN abs(zscore) >= 2 THEN 'outlier'
       WHEN abs(coalesce(pct, 0)) >= 0.5 THEN 'critical' WHEN abs(coalesce(pct, 0)) >= 0.25 THEN 'relevant'
       WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END"""

FOCUS = """focus AS (
  SELECT * FROM v WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, delta, period LIMIT 1
)"""

SERIES = ctes(MART, series(), moves())
CLOSED = ctes(MART, series(), moves(), FOCUS)

DIMENSIONS = ("product_type", "segment", "region", "brand")
DIM_ORDER = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DIMENSIONS)) + " END"


def long_entities(dimensions=DIMENSIONS, name: str = "ep") -> str:
    parts = [
        f"SELECT '{d}' AS dimension, {d} AS name, period, CAST(sum(amount) AS DOUBLE) AS value "
        f"FROM m WHERE {d} IS NOT NULL GROUP BY {d}, period"
        for d in dimensions
    ]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


CONTRIBUTIONS = """cur AS (SELECT dimension, name, value FROM ep WHERE period = (SELECT period FROM focus)),
prv AS (SELECT dimension, name, value FROM ep WHERE period = (SELECT prev_period FROM focus)),
hist AS (SELECT dimension, name, CAST(sum(CAST(value AS DECIMAL(38,4))) AS DOUBLE) / count(value) AS hist_mean FROM ep GROUP BY dimension, name),
con AS (
  SELECT coalesce(cur.dimension, prv.dimension) AS dimension, coalesce(cur.name, prv.name) AS name,
         coalesce(cur.value, 0) AS current_value, coalesce(prv.value, 0) AS previous_value,
         coalesce(cur.value, 0) - coalesce(prv.value, 0) AS delta
  FROM cur FULL OUTER JOIN prv ON cur.dimension = prv.dimension AND cur.name = prv.name
),
tot AS (
  SELECT dimension, sum(abs(delta)) AS abs_total FROM con
  GROUP BY dimension HAVING count(*) >= 2 AND sum(abs(delta)) > 0
)"""

RECURRENCE = """recent AS (
  SELECT period, row_number() OVER (ORDER BY period DESC) - 1 AS slot
  FROM s WHERE period <= (SELECT period FROM focus)
),
names AS (SELECT DISTINCT dimension, name FROM ep),
grid AS (
  SELECT n.dimension, n.name, r.slot, r.period, coalesce(ep.value, 0) AS value
  FROM names n CROSS JOIN (SELECT * FROM recent WHERE slot < 4) r
  LEFT JOIN ep ON ep.dimension = n.dimension AND ep.name = n.name AND ep.period = r.period
),
step AS (
  SELECT *, abs(value - lag(value) OVER (PARTITION BY dimension, name ORDER BY period)) AS size FROM grid
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY dimension, period ORDER BY size DESC, name) AS rn
  FROM step WHERE size IS NOT NULL
),
rec AS (
  SELECT dimension, name, count(*) AS appearances FROM placed WHERE rn <= 3 GROUP BY dimension, name
)"""

TOP = """top AS (
  SELECT c.dimension, c.name,
         row_number() OVER (PARTITION BY c.dimension ORDER BY abs(c.delta) DESC, c.name) AS position,
         round(c.current_value, 4) AS current_value, round(c.previous_value, 4) AS previous_value,
         round(c.delta, 4) AS delta, round(c.delta / nullif(abs(c.previous_value), 0), 4) AS pct,
         round(abs(c.delta) / t.abs_total, 4) AS share_abs,
         round(c.delta / nullif((SELECT delta FROM focus), 0), 4) AS share_total,
         round(h.hist_mean, 4) AS hist_mean, round(c.current_value - h.hist_mean, 4) AS hist_delta,
         CASE WHEN abs(c.delta) / t.abs_total >= 0.8 THEN 'high'
              WHEN abs(c.delta) / t.abs_total >= 0.6 THEN 'medium' ELSE 'low' END AS concentration,
         CASE WHEN coalesce(r.appearances, 0) >= 2 THEN 'recurrent' ELSE 'one_off' END AS recurrence
  FROM con c JOIN tot t USING (dimension)
  LEFT JOIN hist h ON h.dimension = c.dimension AND h.name = c.name
  LEFT JOIN rec r ON r.dimension = c.dimension AND r.name = c.name
  QUALIFY position <= 8
)"""

IMPACT = """impact AS (
  SELECT *, row_number() OVER (ORDER BY abs(share_abs) DESC, abs(delta) DESC, abs(hist_delta) DESC,
                               dimension, name) AS impact_rank
  FROM top WHERE position <= 5 QUALIFY impact_rank <= 12
)"""


def root(dimensions=DIMENSIONS) -> str:
    return ctes(
        MART, series(), moves(), FOCUS, long_entities(dimensions), CONTRIBUTIONS, RECURRENCE, TOP, IMPACT
    )


ROOT = root()
