"""Column-role and audit queries over a retail view with business column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.columns import round_to
from movara.functions.names import ADJUSTMENT_TERMS, IDENTIFIER_TERMS, NOISE_TERMS
from movara.functions.sharing import shared
from movara.operators import audit, dashboard, filters, quality
from movara.operators import roles as R
from movara.operators import vocabulary as V
from movara.plans import profiling
from movara.plans import sql as S
from movara.plans.profiling import outlier_sql
from movara.plans.registry import query
from movara.sources.mart import dirty_lines, sales_mart, table

# name, class, SQL expression
_RETAIL = [
    ("codigo_pedido", "numeric", "l_orderkey"),
    ("data_venda", "text", "strftime(l_shipdate, '%d/%m/%Y')"),
    ("competencia", "text", "strftime(l_shipdate, '%Y-%m')"),
    ("trimestre", "text", "strftime(l_shipdate, '%Y') || '-T' || quarter(l_shipdate)"),
    ("carga_timestamp", "numeric", "CAST(epoch(l_shipdate) AS BIGINT)"),
    ("carga", "numeric", "CAST(epoch(l_shipdate) AS BIGINT)"),
    ("produto", "text", "p_name"),
    ("categoria", "text", "p_type"),
    ("situacao", "text", "l_linestatus"),
    ("valor_total", "numeric", "l_extendedprice"),
    ("receita_liquida", "numeric", "CASE WHEN l_partkey % 9 = 0 THEN -l_extendedprice ELSE l_extendedprice END"),
    ("compra_media", "numeric", "CASE WHEN l_partkey % 2 = 0 THEN -l_tax ELSE l_tax END"),
    ("desconto", "numeric", "l_discount"),
    ("quantidade", "numeric", "l_quantity"),
    ("margem", "numeric", "1 - l_discount"),
    ("prazo_dias", "numeric", "l_linenumber"),
    ("observacao", "text", "CAST(NULL AS VARCHAR)"),
]


def retail(spark, sf_dir) -> DataFrame:
    """Line items under the column names of a retail export."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    epoch = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    signed = lambda c, n: F.when(F.col("l_partkey") % n == 0, -F.col(c)).otherwise(F.col(c))
    quarter = F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-T"), F.quarter("l_shipdate").cast("string"))
    made = {
        "codigo_pedido": F.col("l_orderkey"),
        "data_venda": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "competencia": F.date_format("l_shipdate", "yyyy-MM"),
        "trimestre": quarter,
        "carga_timestamp": epoch,
        "carga": epoch,
        "produto": F.col("p_name"),
        "categoria": F.col("p_type"),
        "situacao": F.col("l_linestatus"),
        "valor_total": F.col("l_extendedprice"),
        "receita_liquida": signed("l_extendedprice", 9),
        "compra_media": signed("l_tax", 2),
        "desconto": F.col("l_discount"),
        "quantidade": F.col("l_quantity"),
        "margem": 1 - F.col("l_discount"),
        "prazo_dias": F.col("l_linenumber"),
        "observacao": F.lit(None).cast("string"),
    }
    return lines.select(*[c.alias(n) for n, c in made.items()])


def _match(patterns, x: str) -> str:
    return "greatest(" + ", ".join(f"avg(regexp_matches({x}, '{p}')::INT)" for p in patterns) + ")"


_UNIX = "(abs(TRY_CAST({0} AS DOUBLE)) BETWEEN 946684800 AND 4102444800 OR abs(TRY_CAST({0} AS DOUBLE)) BETWEEN 946684800000 AND 4102444800000)"
_PERIODISH = "regexp_matches({0}, '^\\d{{4}}[/-]\\d{{1,2}}$') OR regexp_matches({0}, '^\\d{{4}}-T[1-4]$')"


def _catalog_row(position: int, name: str, kind: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    is_text, numeric = kind == "text", kind == "numeric"
    unix = _UNIX.format(text)
    period = _PERIODISH.format(text)
    parsed = (
        f"avg((try_strptime({text}, '%d/%m/%Y') IS NOT NULL OR {period} OR {unix})::INT)" if is_text else f"avg(({unix})::INT)"
    )
    full = "|".join(f"(?:{p})" for p in R.FULL_DATE_SHAPES)
    zero = "0.0::DOUBLE"
    parts = {
        "month_ratio": _match(R.MONTH_SHAPES, text) if is_text else zero,
        "period_ratio": _match(R.MONTH_SHAPES[:2] + R.QUARTER_SHAPES[:2], text) if is_text else zero,
        "quarter_ratio": _match(R.QUARTER_SHAPES, text) if is_text else zero,
        "full_date_ratio": f"avg(regexp_matches({text}, '{full}')::INT)" if is_text else zero,
        "unix_ratio": f"avg(({unix})::INT)",
        "parsed_ratio": parsed,
        "negative_ratio": f"count(*) FILTER (WHERE {name} < 0) / count({name})" if numeric else zero,
        "abs_sum": f"CAST(sum(CAST(abs({name}) AS DECIMAL(28,4))) AS DOUBLE)" if numeric else zero,
        "positive_sum": f"CAST(sum(CAST(greatest({name}, 0) AS DECIMAL(28,4))) AS DOUBLE)" if numeric else zero,
    }
    figures = ", ".join(f"coalesce({e}, 0) AS {n}" for n, e in parts.items())
    return f"SELECT '{name}' AS \"column\", {position} AS position, '{kind}' AS class, count({name}) AS present, {figures} FROM rt"


_VIEW = "rt AS (SELECT " + ", ".join(f"{e} AS {n}" for n, _, e in _RETAIL) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
_HINT = f"regexp_matches(\"column\", '{'|'.join(V.DATE_NAME_TERMS)}')"
_TYPED = (
    "cat AS ("
    + "\nUNION ALL ".join(_catalog_row(i, n, k) for i, (n, k, _) in enumerate(_RETAIL))
    + f"""),
ty AS (SELECT *, CASE WHEN class = 'numeric' AND {_HINT} AND parsed_ratio >= 0.8 THEN 'datetime' WHEN class = 'numeric' THEN 'numeric'
  WHEN present = 0 OR period_ratio >= 0.65 THEN 'categorical' WHEN full_date_ratio < 0.65 AND NOT {_HINT} THEN 'categorical'
  WHEN parsed_ratio >= 0.8 THEN 'datetime' ELSE 'categorical' END AS type FROM cat)"""
)
BASE = f"WITH {_VIEW},\n{_TYPED}"


def typed(spark, sf_dir) -> DataFrame:
    return R.profile(retail(spark, sf_dir))


@query(
    "column_catalog",
    BASE
    + """ SELECT "column", position, class, present, round(month_ratio, 4) AS month_ratio, round(quarter_ratio, 4) AS quarter_ratio,
  round(full_date_ratio, 4) AS full_date_ratio, round(unix_ratio, 4) AS unix_ratio, round(negative_ratio, 4) AS negative_ratio,
  round(abs_sum, 2) AS abs_sum, round(positive_sum, 2) AS positive_sum FROM cat""",
)
def column_catalog(spark, sf_dir):
    places = {c: 4 for c in ("month_ratio", "quarter_ratio", "full_date_ratio", "unix_ratio", "negative_ratio")}
    places |= {"abs_sum": 2, "positive_sum": 2}
    rows = R.column_catalog(retail(spark, sf_dir))
    return rows.select("column", "position", "class", "present", *[round_to(c, n).alias(c) for c, n in places.items()])


@query("column_types", BASE + ' SELECT "column", type FROM ty')
def column_types(spark, sf_dir):
    return typed(spark, sf_dir).select("column", "type")


_SUGGEST = """, sg0 AS (SELECT *, CASE WHEN month_ratio >= 0.65 OR (contains("column", 'mes') AND month_ratio >= 0.35) THEN 'month_period'
  WHEN quarter_ratio >= 0.65 OR (contains("column", 'trim') AND quarter_ratio >= 0.35) THEN 'quarter_period'
  WHEN unix_ratio >= 0.8 OR (contains("column", 'timestamp') AND unix_ratio >= 0.35) THEN 'unix_timestamp' END AS kind FROM ty WHERE type <> 'datetime' AND present > 0),
sg AS (SELECT "column", kind, round(CASE kind WHEN 'month_period' THEN month_ratio WHEN 'quarter_period' THEN quarter_ratio ELSE unix_ratio END, 2) AS confidence
  FROM sg0 WHERE kind IS NOT NULL
  UNION ALL SELECT "column", 'datetime', 1.0 FROM ty WHERE type = 'datetime')"""


@query("period_suggest", BASE + _SUGGEST + ' SELECT "column", kind, confidence FROM sg')
def period_suggest(spark, sf_dir):
    return R.date_candidates(typed(spark, sf_dir)).select("column", "kind", "confidence")


def _whole(terms) -> str:
    options = "|".join(terms)
    return f"regexp_matches(\"column\", '^(?:{options})(?:_|$)|(?:^|_)(?:{options})$')"


_ADJUST = f"regexp_matches(\"column\", '{'|'.join(ADJUSTMENT_TERMS)}')"


@query(
    "name_flags",
    BASE
    + f""" SELECT "column", present, {_whole(IDENTIFIER_TERMS)}::INT AS is_identifier, {_whole(NOISE_TERMS)}::INT AS is_noise,
  {_ADJUST}::INT AS is_adjustment FROM cat""",
)
def name_flags(spark, sf_dir):
    return R.flagged_names(R.name_catalog(retail(spark, sf_dir)))


def _vocab(name: str, groups: dict) -> str:
    rows = ", ".join(f"('{g}', {i}, '{t}', {gi})" for gi, (g, terms) in enumerate(groups.items()) for i, t in enumerate(terms))
    return f"{name}(vocabulary, rank, term, g) AS (VALUES {rows})"


@query(
    "vocab_match",
    BASE
    + ", "
    + _vocab("vo", V.DASHBOARD_DOMAINS)
    + """ SELECT "column", vocabulary, rank, term, present FROM cat JOIN vo ON contains("column", term)""",
)
def vocab_match(spark, sf_dir):
    hits = R.vocabulary_matches(R.name_catalog(retail(spark, sf_dir)), V.DASHBOARD_DOMAINS)
    return hits.select("column", "vocabulary", "rank", "term", "present")


_SCORES = f""", {_vocab("vo", {"domain": V.DASHBOARD_METRIC_TERMS["vendas"], "value": V.VALUE_TERMS})},
pts AS (SELECT "column", sum(CASE vocabulary WHEN 'domain' THEN greatest(18, 120 - rank * 5) ELSE greatest(10, 80 - rank * 3) END) AS points
  FROM ty JOIN vo ON contains("column", term) WHERE type = 'numeric' GROUP BY 1),
ms AS (SELECT ty."column", round(CASE WHEN {_whole(IDENTIFIER_TERMS).replace('"column"', 'ty."column"')} OR {_whole(NOISE_TERMS).replace('"column"', 'ty."column"')} OR present = 0 THEN -1000.0::DOUBLE
  ELSE coalesce(points, 0)::DOUBLE - CASE WHEN {_ADJUST.replace('"column"', 'ty."column"')} THEN 220 ELSE 0 END
   - CASE WHEN regexp_matches(ty."column", '{'|'.join(V.PURCHASE_WORDS)}') THEN 70 ELSE 0 END
   - CASE WHEN regexp_matches(ty."column", '{'|'.join(V.NEGATIVE_ALLOWED_TERMS)}') THEN 0 ELSE negative_ratio * 160 END
   - CASE WHEN NOT regexp_matches(ty."column", '{'|'.join(V.NEGATIVE_ALLOWED_TERMS)}') AND negative_ratio >= 0.35 THEN 120 ELSE 0 END
   - CASE WHEN abs_sum = 0 THEN 40 ELSE 0 END END, 4) AS score
  FROM ty LEFT JOIN pts ON pts."column" = ty."column" WHERE type = 'numeric')"""


@query(
    "metric_score",
    BASE + _SCORES + ' SELECT "column", score, row_number() OVER (ORDER BY score DESC, "column" DESC) AS rank FROM ms',
)
def metric_score(spark, sf_dir):
    return R.metric_scores(typed(spark, sf_dir), "vendas", V.DASHBOARD_METRIC_TERMS["vendas"], V.VALUE_TERMS)


_ROLES = f""", {_vocab("vo", {"primary_metric": V.PRIMARY_METRICS["vendas"], **V.SUPPORT_METRICS["vendas"]})},
rs AS (SELECT vocabulary AS role, "column", CAST(sum(100 - rank * 4) - CASE WHEN {_whole(V.SHORT_IDENTIFIER_TERMS)} THEN 500 ELSE 0 END AS BIGINT) AS score
  FROM ty JOIN vo ON contains("column", term) WHERE type = 'numeric' GROUP BY vocabulary, "column"),
pm AS (SELECT role, "column", score FROM rs WHERE role = 'primary_metric' AND score > 0 ORDER BY score DESC, "column" DESC LIMIT 1)"""


@query(
    "metric_map",
    BASE
    + _ROLES
    + """ SELECT * FROM pm UNION ALL
SELECT role, "column", score FROM rs WHERE role <> 'primary_metric' AND score > 0 AND "column" <> (SELECT "column" FROM pm)
QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, "column" DESC) = 1""",
)
def metric_map(spark, sf_dir):
    return R.metric_map(typed(spark, sf_dir), V.PRIMARY_METRICS["vendas"], V.SUPPORT_METRICS["vendas"])


def _domain_sql(rule_set: str, terms: dict, metrics: dict | None) -> str:
    extra = (
        f' UNION SELECT vocabulary, term, 2 FROM cat JOIN (SELECT * FROM {rule_set}_m) ON contains("column", term)' if metrics else ""
    )
    return f"""{rule_set}_h AS (SELECT vocabulary, term, 1 AS w FROM cat JOIN {rule_set}_t ON contains("column", term){extra}),
{rule_set}_s AS (SELECT '{rule_set}' AS rule_set, vocabulary AS domain, CAST(sum(w) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM {rule_set}_h) GROUP BY 2)"""


_METRICS_BY_DOMAIN = {d: V.PRIMARY_METRICS[d] for d in V.ANALYSIS_DOMAINS}
_DOMAIN_ORDER = "CASE domain " + " ".join(
    f"WHEN '{d}' THEN {i}" for i, d in enumerate(("estoque_operacao", "vendas", "compras", "clientes", "estoque", "financeiro"))
) + " END"


@query(
    "domain_score",
    BASE
    + ", "
    + ",\n".join(
        [
            _vocab("dashboard_t", V.DASHBOARD_DOMAINS),
            _vocab("analysis_t", V.ANALYSIS_DOMAINS),
            _vocab("analysis_m", _METRICS_BY_DOMAIN),
            _domain_sql("dashboard", V.DASHBOARD_DOMAINS, None),
            _domain_sql("analysis", V.ANALYSIS_DOMAINS, _METRICS_BY_DOMAIN),
        ]
    )
    + f""" SELECT *, row_number() OVER (PARTITION BY rule_set ORDER BY score DESC, {_DOMAIN_ORDER}) AS rank
FROM (SELECT * FROM dashboard_s UNION ALL SELECT * FROM analysis_s)""",
)
def domain_score(spark, sf_dir):
    catalog = typed(spark, sf_dir)
    first = R.domain_scores(catalog, V.DASHBOARD_DOMAINS).withColumn("rule_set", F.lit("dashboard"))
    second = R.domain_scores(catalog, V.ANALYSIS_DOMAINS, _METRICS_BY_DOMAIN).withColumn("rule_set", F.lit("analysis"))
    return first.unionByName(second).select("rule_set", "domain", "score", "rank")


@query(
    "dimension_pick",
    BASE
    + ", "
    + _vocab("vo", V.DIMENSION_GROUPS)
    + """, h AS (SELECT vocabulary, g, "column", position FROM ty JOIN vo ON contains("column", term) WHERE type = 'categorical'
  QUALIFY row_number() OVER (PARTITION BY vocabulary ORDER BY rank, position) = 1),
o AS (SELECT "column", vocabulary AS label, g AS o FROM h QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY g) = 1),
a AS (SELECT * FROM o UNION ALL SELECT "column", 'grupo', position + 1000 FROM ty WHERE type = 'categorical' AND "column" NOT IN (SELECT "column" FROM o))
SELECT "column", label, row_number() OVER (ORDER BY o) AS rank FROM a""",
)
def dimension_pick(spark, sf_dir):
    return R.pick_dimensions(typed(spark, sf_dir), V.DIMENSION_GROUPS)


@query(
    "fallback_metric",
    BASE
    + f""" SELECT (SELECT "column" FROM ty WHERE type = 'numeric' ORDER BY (NOT {_whole(IDENTIFIER_TERMS)} AND NOT ({_whole(NOISE_TERMS)} OR {_ADJUST})) DESC,
   (NOT {_whole(IDENTIFIER_TERMS)}) DESC, positive_sum DESC, position LIMIT 1) AS dashboard_metric,
 (SELECT "column" FROM ty WHERE type = 'numeric' ORDER BY (NOT {_whole(V.SHORT_IDENTIFIER_TERMS)}) DESC, abs_sum DESC, position LIMIT 1) AS analysis_metric""",
)
def fallback_metric(spark, sf_dir):
    return R.fallback_metrics(typed(spark, sf_dir))


@query(
    "time_axis",
    """SELECT 'fiscal' AS source, 'ano_fiscal + mes_pedido' AS "columns", round(avg((o_orderkey % 5 <> 4)::INT), 4) AS ratio FROM orders
UNION ALL SELECT 'retail', 'data_venda', round(avg(1.0), 4) FROM lineitem
UNION ALL SELECT 'month_only', NULL, NULL FROM (SELECT count(*) FROM orders)""",
)
def time_axis(spark, sf_dir):
    from movara.plans.parsing import fiscal_parts

    orders = table(spark, sf_dir, "orders")
    fiscal = fiscal_parts(orders).select(F.col("year_text").alias("ano_fiscal"), F.col("month_text").alias("mes_pedido"), "o_orderkey")
    names = F.array(*[F.lit(m) for m in "jan fev mar abr mai jun jul ago set out nov dez".split()])
    month_name = F.concat(F.lit("01-"), F.element_at(names, F.month("o_orderdate")))
    month_only = orders.select(month_name.alias("mes"), F.col("o_orderpriority").alias("prioridade"))
    axis = lambda df, source: R.time_axis(df, R.profile(df)).select(
        F.lit(source).alias("source"), "columns", "ratio"
    )
    return (
        axis(fiscal, "fiscal").unionByName(axis(retail(spark, sf_dir), "retail")).unionByName(axis(month_only, "month_only"))
    )


# ---- audit ----------------------------------------------------------------

def exported_lines(spark, sf_dir) -> DataFrame:
    """The defective lines under export-style names."""
    rows = dirty_lines(spark, sf_dir)
    return rows.select(
        F.col("l_orderkey").alias("codigo_pedido"),
        F.col("l_partkey").alias("peca"),
        F.col("l_suppkey").alias("fornecedor"),
        F.col("l_linenumber").alias("linha"),
        "quantity",
        F.col("price").alias("valor_total"),
        F.col("net").alias("receita"),
        "flat",
        "flag",
        "status",
        F.col("note").alias("coluna_11"),
    )


_MEASURES = ["quantity", "valor_total", "receita", "flat"]
_AUDIT = f"""{profiling.DIRTY}, {profiling.SCORE},
neg AS (SELECT round(count(*) FILTER (WHERE net < 0) / count(net), 4) AS r, sum(net) AS t FROM d),
worst AS (SELECT max(missing) / (SELECT count(*) FROM d) AS w FROM miss),
ev AS (SELECT *, missing_total / (rows * columns) AS mr, duplicate_rows / rows AS dr FROM score),
fo AS (SELECT max(outliers) / (SELECT count(*) FROM d) AS r FROM ob WHERE outliers > 0),
fi AS (
  SELECT 'generic_header' AS finding, 'warning' AS severity, 1.0::DOUBLE AS measure FROM score
  UNION ALL SELECT 'no_date', 'warning', 0.0 FROM score
  UNION ALL SELECT 'negatives_receita', 'warning', r FROM neg WHERE t >= 0 AND r > 0.05
  UNION ALL SELECT 'negative_total_receita', 'critical', round(t, 4) FROM neg WHERE t < 0
  UNION ALL SELECT 'missing_values', CASE WHEN mr >= 0.25 THEN 'critical' WHEN mr >= 0.08 OR (SELECT w FROM worst) >= 0.35 THEN 'warning' ELSE 'info' END, round(mr, 4) FROM ev WHERE missing_total > 0
  UNION ALL SELECT 'duplicate_rows', CASE WHEN dr >= 0.1 THEN 'critical' ELSE 'warning' END, round(dr, 4) FROM ev WHERE duplicate_rows > 0
  UNION ALL SELECT 'numeric_outliers', CASE WHEN r >= 0.08 THEN 'warning' ELSE 'info' END, round(r, 4) FROM fo WHERE r IS NOT NULL
  UNION ALL SELECT 'numeric_identifiers', 'info', 1.0 FROM score
)"""


@query(
    "audit_findings",
    _AUDIT
    + """ SELECT finding, severity, measure, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, finding) AS position FROM fi""",
)
def audit_findings(spark, sf_dir):
    found = audit.audit_findings(exported_lines(spark, sf_dir), ["receita"], "vendas", _MEASURES)
    return audit.ordered_findings(found)


@query(
    "audit_score",
    _AUDIT
    + """ SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warnings,
 count(*) FILTER (WHERE severity = 'info') AS notes, CAST(sum(CASE severity WHEN 'critical' THEN 18 WHEN 'warning' THEN 9 ELSE 3 END) AS BIGINT) AS points_lost,
 CAST(greatest(0, least(100, (SELECT score FROM score) - sum(CASE severity WHEN 'critical' THEN 18 WHEN 'warning' THEN 9 ELSE 3 END))) AS BIGINT) AS score FROM fi""",
)
def audit_score(spark, sf_dir):
    rows = exported_lines(spark, sf_dir)
    scored = shared(quality.quality_score(rows, _MEASURES))
    found = audit.audit_findings(rows, ["receita"], "vendas", _MEASURES, scored=scored)
    return audit.audit_score(found, scored)


# ---- dashboard ------------------------------------------------------------

_CHOSEN = {"segment": ["BUILDING", "MACHINERY"]}
_FILTERED = "m WHERE segment IN ('BUILDING', 'MACHINERY') AND ship_ts >= TIMESTAMP '1997-01-01' AND ship_ts <= TIMESTAMP '1998-12-31'"


def _filtered_mart(spark, sf_dir, *columns: str):
    mart = sales_mart(spark, sf_dir, *columns)
    return mart, filters.categories(mart, _CHOSEN) & filters.date_range("ship_ts", "1997-01-01", "1998-12-31")


@query(
    "dashboard_filtered",
    S.ctes(
        S.MART,
        f"fm AS (SELECT order_id, ship_ts, CAST(amount AS DOUBLE) AS amount, margin_rate, quantity, tax, supplier, product, segment FROM {_FILTERED})",
        outlier_sql("fm", ["amount"]),
        """qz AS (SELECT (SELECT count(*) FROM fm) AS n, (SELECT count(*) FROM fm) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fm)) AS dups,
  (SELECT coalesce(sum(outliers), 0) FROM ob) AS outs)""",
    )
    + f""" SELECT CAST(1 AS BIGINT) AS chart_order, 'monthly' AS chart, period AS label, round(CAST(sum(amount) AS DOUBLE), 4) AS value FROM {_FILTERED} GROUP BY period
UNION ALL (SELECT 2, 'ranking_product_type', product_type, round(CAST(sum(amount) AS DOUBLE), 4) AS t FROM {_FILTERED} GROUP BY product_type ORDER BY t DESC, product_type LIMIT 8)
UNION ALL (SELECT 3, 'margin_product_type', product_type, round(round(avg(margin_rate), 6), 4) AS t FROM {_FILTERED} GROUP BY product_type ORDER BY round(avg(margin_rate), 6) DESC, product_type LIMIT 8)
UNION ALL SELECT 4, 'quality', indicator, value FROM (
  SELECT 'quality' AS indicator, CAST(greatest(0, round_even(100 - (round(least(25.0, dups / n * 25.0), 2) + round(least(10.0, outs / n * 10.0), 2)), 0)) AS DOUBLE) AS value FROM qz
  UNION ALL SELECT 'missing_pct', 0.0 FROM qz UNION ALL SELECT 'duplicate_pct', round(dups / n * 100, 2) FROM qz UNION ALL SELECT 'outlier_pct', round(outs / n * 100, 2) FROM qz)""",
)
def dashboard_filtered(spark, sf_dir):
    columns = ("order_id", "ship_ts", "period", "amount", "segment", "product_type", "margin_rate", "quantity", "tax", "supplier", "product")
    mart, condition = _filtered_mart(spark, sf_dir, *columns)
    return dashboard.dashboard(mart, condition, "amount", "period", ["product_type", "segment"], "margin_rate", ["amount"])


@query(
    "kpis",
    f"""{profiling.DIRTY.replace("FROM lineitem", ", l_shipdate FROM lineitem", 1)}, {profiling.SCORE.replace(f"CAST({len(profiling.DIRTY_COLUMNS)} AS BIGINT)", "CAST(12 AS BIGINT)")}
SELECT 'rows' AS kpi, CAST(rows AS DOUBLE) AS value, 12.0::DOUBLE AS detail, 'neutral' AS tone, CAST(NULL AS VARCHAR) AS span FROM score
UNION ALL SELECT 'metric', round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE), 2), round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price), 4), 'accent', NULL FROM d
UNION ALL SELECT 'score', CAST(score AS DOUBLE), NULL, CASE WHEN score >= 85 THEN 'good' WHEN score >= 65 THEN 'warning' ELSE 'danger' END, NULL FROM score
UNION ALL SELECT 'duplicates', CAST(duplicate_rows AS DOUBLE), round(duplicate_rows / rows, 4), CASE WHEN duplicate_rows = 0 THEN 'good' ELSE 'warning' END, NULL FROM score
UNION ALL SELECT 'months', CAST(count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS DOUBLE), NULL, 'neutral', strftime(min(l_shipdate), '%Y-%m-%d') || '..' || strftime(max(l_shipdate), '%Y-%m-%d') FROM d""",
)
def kpis(spark, sf_dir):
    rows = dirty_lines(spark, sf_dir, "l_shipdate").withColumn("price", F.col("price").cast("decimal(18,2)"))
    return dashboard.kpis(rows, "price", "l_shipdate", quality.quality_score(rows, profiling.MEASURES))
