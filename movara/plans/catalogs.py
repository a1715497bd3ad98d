"""Column roles of many tables in one job: a typed catalog with a table key, and every role rule table by table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.names import ADJUSTMENT_TERMS, IDENTIFIER_TERMS, NOISE_TERMS
from movara.functions.columns import round_to
from movara.operators import roles as R
from movara.operators import vocabulary as V
from movara.plans.registry import query
from movara.plans.roles import _catalog_row, _vocab
from movara.sources.mart import table

#: Columns of the star tables by class: n a number, d a time, t a text.
STAR = {
    "region": "r_regionkey n, r_name t",
    "nation": "n_nationkey n, n_name t, n_regionkey n",
    "customer": "c_custkey n, c_name t, c_nationkey n, c_acctbal n, c_mktsegment t",
    "supplier": "s_suppkey n, s_name t, s_nationkey n, s_acctbal n",
    "part": "p_partkey n, p_name t, p_brand t, p_type t, p_size n, p_retailprice n",
    "orders": "o_orderkey n, o_custkey n, o_orderstatus t, o_totalprice n, o_orderdate d, o_orderpriority t",
    "lineitem": "l_orderkey n, l_partkey n, l_suppkey n, l_linenumber n, l_quantity n, l_extendedprice n, l_discount n, l_tax n, l_returnflag t, l_linestatus t, l_shipdate d",
    "events": "event_id n, user_id n, ts d, event_type t, value n, props t",
}
_CLASS = {"n": "numeric", "d": "datetime", "t": "text"}
#: The export names under which the rules of names have something to find; the other columns keep theirs.
RENAMED = {
    "o_orderkey": "codigo_pedido", "o_totalprice": "valor_total", "o_orderpriority": "prioridade_categoria", "l_extendedprice": "receita_venda", "l_discount": "desconto",
    "l_quantity": "quantidade", "p_retailprice": "preco_produto", "p_type": "categoria", "p_name": "produto", "c_name": "cliente", "c_acctbal": "saldo_cliente",
    "c_mktsegment": "segmento", "s_name": "fornecedor", "s_acctbal": "custo_compra", "n_name": "regiao", "l_linenumber": "numero", "value": "valor",
}


def star(spark, sf_dir) -> dict[str, DataFrame]:
    """The eight tables, money and sizes under the names of a business export."""
    tables = {}
    for name, columns in STAR.items():
        own = [c.split()[0] for c in columns.split(", ")]
        tables[name] = table(spark, sf_dir, name).select(*[F.col(c).alias(RENAMED.get(c, c)) for c in own])
    return tables


def typed(spark, sf_dir) -> DataFrame:
    return R.profiles(star(spark, sf_dir))


def _rows() -> str:
    views, rows = [], []
    for name, columns in STAR.items():
        own = [c.split() for c in columns.split(", ")]
        views.append(f"v_{name} AS (SELECT " + ", ".join(f'{c} AS "{RENAMED.get(c, c)}"' for c, _ in own) + f" FROM {name})")
        for position, (column, kind) in enumerate(own):
            row = _catalog_row(position, RENAMED.get(column, column), _CLASS[kind])
            rows.append(f"""SELECT '{name}' AS "table", """ + row.removeprefix("SELECT ").replace("FROM rt", f"FROM v_{name}"))
    return ",\n".join(views) + ",\ncat AS (" + "\nUNION ALL ".join(rows) + ")"


_HINT = f"regexp_matches(\"column\", '{'|'.join(V.DATE_NAME_TERMS)}')"
BASE = f"""WITH {_rows()},
ty AS (SELECT *, CASE WHEN class = 'numeric' AND {_HINT} AND parsed_ratio >= 0.8 THEN 'datetime' WHEN class = 'numeric' THEN 'numeric' WHEN class = 'datetime' THEN 'datetime'
  WHEN present = 0 OR period_ratio >= 0.65 THEN 'categorical' WHEN full_date_ratio < 0.65 AND NOT {_HINT} THEN 'categorical'
  WHEN parsed_ratio >= 0.8 THEN 'datetime' ELSE 'categorical' END AS type FROM cat)"""


def _whole(terms, column: str = 'ty."column"') -> str:
    options = "|".join(terms)
    return f"regexp_matches({column}, '^(?:{options})(?:_|$)|(?:^|_)(?:{options})$')"


def _any(terms, column: str = 'ty."column"') -> str:
    return f"regexp_matches({column}, '{'|'.join(terms)}')"


@query(
    "catalog_types",
    BASE + """ SELECT "table", "column", CAST(position AS INTEGER) AS position, class, present, type, round(negative_ratio, 4) AS negative_ratio, round(abs_sum, 2) AS abs_sum FROM ty""",
)
def catalog_types(spark, sf_dir):
    return typed(spark, sf_dir).select("table", "column", "position", "class", "present", "type", round_to("negative_ratio").alias("negative_ratio"), round_to("abs_sum", 2).alias("abs_sum"))


@query("catalog_periods", BASE + """ SELECT "table", "column", 'datetime' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM ty WHERE type = 'datetime'""")
def catalog_periods(spark, sf_dir):
    return R.date_candidates(typed(spark, sf_dir)).select("table", "column", "kind", F.col("confidence").cast("double").alias("confidence"))


@query(
    "catalog_names",
    BASE + f""" SELECT "table", "column", present, {_whole(IDENTIFIER_TERMS)}::INT AS is_identifier, {_whole(NOISE_TERMS)}::INT AS is_noise, {_any(ADJUSTMENT_TERMS)}::INT AS is_adjustment FROM ty""",
)
def catalog_names(spark, sf_dir):
    return R.flagged_names(typed(spark, sf_dir))


_TOLERANT = _any(V.NEGATIVE_ALLOWED_TERMS)


@query(
    "catalog_metrics",
    BASE
    + f""", {_vocab("vo", {"domain": V.DASHBOARD_METRIC_TERMS["vendas"], "value": V.VALUE_TERMS})},
pts AS (SELECT "table", "column", sum(CASE vocabulary WHEN 'domain' THEN greatest(18, 120 - rank * 5) ELSE greatest(10, 80 - rank * 3) END) AS points
  FROM ty JOIN vo ON contains("column", term) WHERE type = 'numeric' GROUP BY ALL),
ms AS (SELECT ty."table", ty."column", round(CASE WHEN {_whole(IDENTIFIER_TERMS)} OR {_whole(NOISE_TERMS)} OR present = 0 THEN -1000.0::DOUBLE
  ELSE coalesce(points, 0)::DOUBLE - CASE WHEN {_any(ADJUSTMENT_TERMS)} THEN 220 ELSE 0 END - CASE WHEN {_any(V.PURCHASE_WORDS)} THEN 70 ELSE 0 END
   - CASE WHEN {_TOLERANT} THEN 0 ELSE negative_ratio * 160 END - CASE WHEN NOT {_TOLERANT} AND negative_ratio >= 0.35 THEN 120 ELSE 0 END
   - CASE WHEN abs_sum = 0 THEN 40 ELSE 0 END END, 4) AS score
  FROM ty LEFT JOIN pts USING ("table", "column") WHERE type = 'numeric')
SELECT "table", "column", score, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, "column" DESC) AS rank FROM ms""",
)
def catalog_metrics(spark, sf_dir):
    return R.metric_scores(typed(spark, sf_dir), "vendas", V.DASHBOARD_METRIC_TERMS["vendas"], V.VALUE_TERMS)


@query(
    "catalog_metric_map",
    BASE
    + f""", {_vocab("vo", {"primary_metric": V.PRIMARY_METRICS["vendas"], **V.SUPPORT_METRICS["vendas"]})},
rs AS (SELECT "table", vocabulary AS role, "column", CAST(sum(100 - rank * 4) - CASE WHEN {_whole(V.SHORT_IDENTIFIER_TERMS)} THEN 500 ELSE 0 END
   - CASE WHEN present = 0 THEN 200 ELSE 0 END AS BIGINT) AS score
  FROM ty JOIN vo ON contains("column", term) WHERE type = 'numeric' GROUP BY "table", vocabulary, "column", present),
pm AS (SELECT * FROM rs WHERE role = 'primary_metric' AND score > 0 QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY score DESC, "column" DESC) = 1),
lg AS (SELECT "table", "column" FROM ty WHERE type = 'numeric'
  QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY (NOT {_whole(V.SHORT_IDENTIFIER_TERMS)}) DESC, abs_sum DESC, position) = 1),
ch AS (SELECT lg."table", 'primary_metric' AS role, coalesce(pm."column", lg."column") AS "column", pm.score FROM lg LEFT JOIN pm USING ("table"))
SELECT * FROM ch UNION ALL
SELECT rs."table", rs.role, rs."column", rs.score FROM rs JOIN ch ON ch."table" = rs."table" WHERE rs.role <> 'primary_metric' AND rs.score > 0 AND rs."column" <> ch."column"
QUALIFY row_number() OVER (PARTITION BY rs."table", rs.role ORDER BY rs.score DESC, rs."column" DESC) = 1""",
)
def catalog_metric_map(spark, sf_dir):
    return R.metric_map(typed(spark, sf_dir), V.PRIMARY_METRICS["vendas"], V.SUPPORT_METRICS["vendas"])


_ORDER = "CASE domain " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(V.ANALYSIS_DOMAINS)) + " END"


@query(
    "catalog_domains",
    BASE
    + f""", {_vocab("vt", V.ANALYSIS_DOMAINS)}, {_vocab("vm", {d: V.PRIMARY_METRICS[d] for d in V.ANALYSIS_DOMAINS})},
h AS (SELECT "table", vocabulary AS domain, term, 1 AS w FROM cat JOIN vt ON contains("column", term) UNION SELECT "table", vocabulary, term, 2 FROM cat JOIN vm ON contains("column", term)),
s AS (SELECT "table", domain, CAST(sum(w) AS BIGINT) AS score FROM h GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, {_ORDER}) AS rank FROM s""",
)
def catalog_domains(spark, sf_dir):
    return R.domain_scores(typed(spark, sf_dir), V.ANALYSIS_DOMAINS, {d: V.PRIMARY_METRICS[d] for d in V.ANALYSIS_DOMAINS})


@query(
    "catalog_dimensions",
    BASE
    + f""", {_vocab("vo", V.DIMENSION_GROUPS)},
h AS (SELECT "table", vocabulary, g, "column", position FROM ty JOIN vo ON contains("column", term) WHERE type = 'categorical'
  QUALIFY row_number() OVER (PARTITION BY "table", vocabulary ORDER BY rank, position) = 1),
o AS (SELECT "table", "column", vocabulary AS label, g AS o FROM h QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY g) = 1),
a AS (SELECT * FROM o UNION ALL SELECT "table", "column", 'grupo', position + 1000 FROM ty ANTI JOIN o USING ("table", "column") WHERE type = 'categorical')
SELECT "table", "column", label, row_number() OVER (PARTITION BY "table" ORDER BY o) AS rank FROM a""",
)
def catalog_dimensions(spark, sf_dir):
    return R.pick_dimensions(typed(spark, sf_dir), V.DIMENSION_GROUPS)


@query(
    "catalog_fallback",
    BASE
    + f""", f AS (SELECT "table", "column", row_number() OVER (PARTITION BY "table" ORDER BY (NOT {_whole(IDENTIFIER_TERMS)} AND NOT ({_whole(NOISE_TERMS)} OR {_any(ADJUSTMENT_TERMS)})) DESC,
   (NOT {_whole(IDENTIFIER_TERMS)}) DESC, positive_sum DESC, position) AS d, row_number() OVER (PARTITION BY "table" ORDER BY (NOT {_whole(V.SHORT_IDENTIFIER_TERMS)}) DESC, abs_sum DESC, position) AS a
  FROM ty WHERE type = 'numeric')
SELECT "table", max("column") FILTER (WHERE d = 1) AS dashboard_metric, max("column") FILTER (WHERE a = 1) AS analysis_metric FROM f GROUP BY ALL""",
)
def catalog_fallback(spark, sf_dir):
    return R.fallback_metrics(typed(spark, sf_dir))
