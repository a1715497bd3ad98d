"""Text, number and date parsing over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions import dates as D
from movara.functions import numbers as N
from movara.functions import text as T
from movara.functions.columns import finite, round_to, safe_text
from movara.plans.registry import query
from movara.sources.mart import table

_NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')"


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_accents("text").alias("plain"))


@query(
    "normalize_text",
    f"""SELECT doc_id, {_NORM.format('text')} AS joined,
       trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced FROM documents""",
)
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.normalize("text").alias("joined"), T.normalize("text", " ").alias("spaced")
    )


@query(
    "slug",
    f"SELECT page_id, trim(regexp_replace({_NORM.format('url')}, '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages",
)
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug("url").alias("slug"))


@query(
    "format_ptbr",
    """WITH v AS (SELECT o_orderkey, o_totalprice AS x, floor(o_totalprice / 1000) AS w, o_totalprice / 1000 AS k FROM orders)
SELECT o_orderkey, CASE WHEN x = floor(x) THEN translate(format('{:,.0f}', x), ',', '.') ELSE translate(format('{:,.2f}', x), ',.', '.,') END AS price_raw,
       CASE WHEN x >= 1000 OR x = floor(x) THEN translate(format('{:,.0f}', x), ',', '.') ELSE translate(format('{:,.2f}', x), ',.', '.,') END AS price_compact,
       translate(format('{:,.0f}', w), ',', '.') AS thousands FROM v""",
)
def format_ptbr(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        N.format_ptbr(price).alias("price_raw"),
        N.format_ptbr(price, compact=True).alias("price_compact"),
        N.format_ptbr(F.floor(price / 1000)).alias("thousands"),
    )


def rendered_prices(lines: DataFrame) -> DataFrame:
    """Line prices as the texts that spreadsheets contain."""
    price, pick = F.col("l_extendedprice"), F.col("l_partkey") % 6
    dotted = F.format_number(price, 2)
    brazil = F.translate(dotted, ",.", ".,")
    text = (
        F.when(pick == 0, F.concat(F.lit("R$ "), brazil))
        .when(pick == 1, dotted)
        .when(pick == 2, F.concat(F.lit("("), brazil, F.lit(")")))
        .when(pick == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")))
        .when(pick == 4, F.translate(F.format_number(F.floor(price), 0), ",", "."))
        .otherwise("n/d")
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("raw"))


_RENDERED = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6
   WHEN 0 THEN 'R$ ' || translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
   WHEN 1 THEN format('{:,.2f}', l_extendedprice)
   WHEN 2 THEN '(' || translate(format('{:,.2f}', l_extendedprice), ',.', '.,') || ')'
   WHEN 3 THEN CAST(l_quantity AS INT) || '%'
   WHEN 4 THEN translate(format('{:,.0f}', floor(l_extendedprice)), ',', '.')
   ELSE 'n/d' END AS raw,
   CASE l_partkey % 6 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice WHEN 2 THEN -l_extendedprice
   WHEN 3 THEN l_quantity WHEN 4 THEN floor(l_extendedprice) END AS expected FROM lineitem)"""


@query(
    "parse_number",
    f"WITH {_RENDERED} SELECT l_orderkey, l_linenumber, l_partkey, raw, expected AS value FROM r",
)
def parse_number(spark, sf_dir):
    rows = rendered_prices(table(spark, sf_dir, "lineitem"))
    return rows.withColumn("value", N.parse_number("raw"))


@query(
    "coerce_ratio",
    f"""WITH {_RENDERED} SELECT 'raw' AS "column", round(count(expected) / count(raw), 4) AS ratio,
       CAST(count(expected) / count(raw) >= 0.8 AS INTEGER) AS numeric FROM r
UNION ALL SELECT 'status', 0.0, 0 FROM (SELECT count(*) FROM lineitem)""",
)
def coerce_ratio(spark, sf_dir):
    from movara.sources.ingest import coercion_ratios

    lines = table(spark, sf_dir, "lineitem")
    rows = rendered_prices(lines).select("raw")
    return coercion_ratios(rows, ["raw"]).unionByName(
        coercion_ratios(lines.select(F.col("l_linestatus").alias("status")), ["status"])
    )


@query(
    "safe_value",
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS raw,
       value, event_id % 5 AS pick, props FROM events)
SELECT event_id, CASE WHEN pick >= 3 THEN value END AS number, props AS cell FROM r""",
)
def safe_value(spark, sf_dir):
    pick = F.col("event_id") % 5
    raw = (
        F.when(pick == 0, "NaN").when(pick == 1, "n/a").when(pick == 2, "Infinity").otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", finite(raw).alias("number"), safe_text("props").alias("cell"))


# ---- periods -------------------------------------------------------------

_NAMES_PT = "jan fev marco abril mai junho jul ago set outubro nov dez".split()


def rendered_periods(events: DataFrame) -> DataFrame:
    """Periods written the way exports write them, one pattern per residue."""
    pick, n = F.col("event_id") % 10, F.col("event_id")
    year = (2000 + n % 60).cast("string")
    month = (n % 14).cast("int")
    padded = F.lpad(month.cast("string"), 2, "0")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES_PT]), (n % 12 + 1).cast("int"))
    short = F.lpad((n % 100).cast("string"), 2, "0")
    quarter = (n % 4 + 1).cast("string")
    text = (
        F.when(pick == 0, F.concat_ws("-", year, padded))
        .when(pick == 1, F.concat_ws("/", padded, year))
        .when(pick == 2, F.concat_ws("/", name, year))
        .when(pick == 3, F.concat_ws("-", F.initcap(name), short))
        .when(pick == 4, F.concat(F.lit("Q"), quarter, F.lit("/"), year))
        .when(pick == 5, F.concat(year, F.lit("-T"), quarter))
        .when(pick == 6, F.concat(quarter, F.lit("T"), short))
        .when(pick == 7, F.concat(F.lit("01-"), F.upper(name)))
        .when(pick == 8, F.concat(F.lit("março "), year))
        .otherwise(F.concat(F.lit("total "), year))
    )
    return events.select("event_id", "ts", text.alias("raw"))


_PERIODS = """p0 AS (SELECT event_id, ts, event_id % 10 AS pick, 2000 + event_id % 60 AS y, event_id % 14 AS m, event_id % 12 + 1 AS nm,
   event_id % 100 AS yy, event_id % 4 + 1 AS q FROM events),
p AS (SELECT *, CASE WHEN yy < 70 THEN 2000 + yy ELSE 1900 + yy END AS yc FROM p0),
per AS (SELECT event_id, ts, pick, CASE WHEN pick IN (0, 1) AND m BETWEEN 1 AND 12 THEN printf('%04d-%02d', y, m)
   WHEN pick = 2 THEN printf('%04d-%02d', y, nm) WHEN pick = 3 THEN printf('%04d-%02d', yc, nm)
   WHEN pick IN (4, 5) THEN printf('%04d-%02d', y, (q - 1) * 3 + 1) WHEN pick = 6 THEN printf('%04d-%02d', yc, (q - 1) * 3 + 1)
   WHEN pick = 7 THEN printf('2000-%02d', nm) WHEN pick = 8 THEN printf('%04d-03', y) END AS month FROM p)"""


@query("parse_period", f"WITH {_PERIODS} SELECT event_id, month FROM per")
def parse_period(spark, sf_dir):
    rows = rendered_periods(table(spark, sf_dir, "events"))
    return rows.select("event_id", D.month_period(D.parse_period("raw")).alias("month"))


@query(
    "parse_dates_dayfirst",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def parse_dates_dayfirst(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return rows.select("o_orderkey", F.date_format(D.parse_dates(rows, "raw"), "yyyy-MM-dd").alias("day"))


def unix_texts(events: DataFrame) -> DataFrame:
    """Epoch seconds on even rows, milliseconds on odd rows, an out-of-range number on every 11th."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor(micros / 1_000_000)
    number = (
        F.when(F.col("event_id") % 11 == 0, F.lit(12345))
        .when(F.col("event_id") % 2 == 0, seconds)
        .otherwise(seconds * 1000)
    )
    return events.select("event_id", number.cast("bigint").alias("raw"))


@query(
    "parse_unix",
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS moment FROM events""",
)
def parse_unix(spark, sf_dir):
    rows = unix_texts(table(spark, sf_dir, "events"))
    return rows.select("event_id", F.date_format(D.parse_unix("raw"), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def mixed_dates(events: DataFrame) -> DataFrame:
    """Period texts, dates of several shapes and unix numbers in one text column."""
    pick = F.col("event_id") % 8
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    text = (
        F.when(pick == 0, F.date_format("ts", "yyyy-MM"))
        .when(pick == 1, F.date_format("ts", "dd/MM/yyyy"))
        .when(pick == 2, seconds.cast("string"))
        .when(pick == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(pick == 5, F.date_format("ts", "MMM d, yyyy"))
        .when(pick == 6, F.date_format("ts", "yyyyMMdd"))
        .otherwise("sem data")
    )
    return events.select("event_id", text.alias("raw"))


@query(
    "parse_common_dates",
    """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN strftime(ts, '%Y-%m-01 00:00:00')
       WHEN event_id % 8 IN (1, 5, 6) THEN strftime(ts, '%Y-%m-%d 00:00:00')
       WHEN event_id % 8 IN (2, 4) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events""",
)
def parse_common_dates(spark, sf_dir):
    rows = mixed_dates(table(spark, sf_dir, "events"))
    return rows.select("event_id", F.date_format(D.parse_common(rows, "raw"), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(
    "date_ratio",
    f"""WITH {_PERIODS} SELECT 'mixed' AS "column", round(count(*) FILTER (WHERE event_id % 4 < 3) / count(*), 4) AS ratio FROM events
UNION ALL SELECT 'period', round(count(month) / count(*), 4) FROM per
UNION ALL SELECT 'event_type', 0.0 FROM (SELECT count(*) FROM events)""",
)
def date_ratio(spark, sf_dir):
    events = table(spark, sf_dir, "events")

    def ratio_of(rows: DataFrame, column: str, name: str) -> DataFrame:
        parsed = D.parse_common(rows, column)
        valued = F.count_if(F.col(column).isNotNull())
        return rows.withColumn("_parsed", parsed).agg(
            F.lit(name).alias("column"), round_to(F.try_divide(F.count("_parsed"), valued)).alias("ratio")
        )

    mixed = ratio_of(mixed_dates(events), "raw", "mixed")
    period = ratio_of(rendered_periods(events), "raw", "period")
    return mixed.unionByName(period).unionByName(ratio_of(events, "event_type", "event_type"))


def fiscal_parts(orders: DataFrame) -> DataFrame:
    """Year and month columns as fiscal exports write them."""
    pick = F.col("o_orderkey") % 5
    year, short = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yy")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES_PT]), F.month("o_orderdate"))
    year_text = (
        F.when(pick == 0, year)
        .when(pick == 1, F.concat(F.lit("FY"), short))
        .when(pick == 2, F.concat(F.lit("Exercício fiscal "), short))
        .when(pick == 3, F.concat(F.lit("ano base "), year))
        .otherwise(F.concat(F.lit("safra "), short))
    )
    month_text = (
        F.when(pick == 0, F.date_format("o_orderdate", "MM"))
        .when(pick == 1, F.upper(name))
        .when(pick == 2, F.concat(F.date_format("o_orderdate", "MM"), F.lit("-"), name))
        .when(pick == 3, F.concat(F.lit("99 "), name))
        .otherwise("total")
    )
    return orders.select("o_orderkey", year_text.alias("year_text"), month_text.alias("month_text"))


_YEAR = "CASE WHEN o_orderkey % 5 <> 4 THEN CAST(year(o_orderdate) AS INTEGER) END"
_MONTH = "CASE WHEN o_orderkey % 5 < 4 THEN CAST(month(o_orderdate) AS INTEGER) END"


@query("year_number", f"SELECT o_orderkey, {_YEAR} AS year FROM orders")
def year_number(spark, sf_dir):
    rows = fiscal_parts(table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", D.year_number("year_text").alias("year"))


@query("month_number", f"SELECT o_orderkey, {_MONTH} AS month FROM orders")
def month_number(spark, sf_dir):
    rows = fiscal_parts(table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", D.month_number("month_text").alias("month"))


@query(
    "year_month_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-01') END AS month_start FROM orders",
)
def year_month_date(spark, sf_dir):
    rows = fiscal_parts(table(spark, sf_dir, "orders"))
    made = D.year_month_date("year_text", "month_text")
    return rows.select("o_orderkey", F.date_format(made, "yyyy-MM-dd").alias("month_start"))
