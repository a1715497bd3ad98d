"""Estimates from month states beside the exact figures, comparison of spellings, and counts taken while writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.columns import round_to
from movara.functions.sharing import shared, shared_folder, written
from movara.operators import filters, rank, sketches
from movara.plans import sql as S
from movara.plans.registry import query
from movara.sources.mart import sales_mart, table

_DISTINCT = ("l_partkey", "l_suppkey")
_SHARES = (0.05, 0.25, 0.5, 0.75, 0.99)


def _month_states(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    skewed = F.when(F.col("l_orderkey") % 3 > 0, 1.0).otherwise(F.col("l_extendedprice"))
    rows = lines.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"), *_DISTINCT, "l_extendedprice", skewed.alias("tied"),
        F.col("l_orderkey").cast("double").alias("ordered"),
    )
    states = sketches.month_states(rows, "month", _DISTINCT, ["l_extendedprice", "tied", "ordered"])
    return written(states, "month-states").withColumn("year", F.substring("month", 1, 4))


@query(
    "distinct_sketch",
    """SELECT strftime(l_shipdate, '%Y') AS year, 'l_partkey' AS "column", count(DISTINCT l_partkey) AS exact, TRUE AS within FROM lineitem GROUP BY 1
UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_suppkey', count(DISTINCT l_suppkey), TRUE FROM lineitem GROUP BY 1""",
)
def distinct_sketch(spark, sf_dir):
    """Distinct parts and suppliers of every year, merged from month states, against the exact counts."""
    years = sketches.merged(_month_states(spark, sf_dir), "year")
    lines = table(spark, sf_dir, "lineitem")
    parts = []
    for column in _DISTINCT:
        exact = lines.groupBy(F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count_distinct(column).alias("exact"))
        estimate = years.select("year", sketches.distinct_estimate(column).alias("estimate"))
        within = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sketches.DISTINCT_ERROR)
        parts.append(exact.join(estimate, "year").select("year", F.lit(column).alias("column"), "exact", within.alias("within")))
    return reduce(DataFrame.unionByName, parts)


@query(
    "quantile_sketch",
    """WITH l AS (SELECT strftime(l_shipdate, '%Y') AS year, l_extendedprice, CASE WHEN l_orderkey % 3 > 0 THEN 1.0 ELSE l_extendedprice END AS tied,
  CAST(l_orderkey AS DOUBLE) AS ordered FROM lineitem)
SELECT year, m AS measure, s AS share, count(*) AS rows, TRUE AS within
FROM l, (VALUES ('l_extendedprice'), ('tied'), ('ordered')) AS ms(m), (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.99::DOUBLE)) AS ss(s) GROUP BY ALL""",
)
def quantile_sketch(spark, sf_dir):
    """Quantiles of every year from merged month states: whether their true ranks keep the bound, on skewed, tied and ordered values."""
    years = sketches.merged(_month_states(spark, sf_dir), "year")
    measures = ("l_extendedprice", "tied", "ordered")
    asked = [F.struct(F.lit(m).alias("measure"), F.lit(s).alias("share"), sketches.quantile_estimate(m, s).alias("estimate")) for m in measures for s in _SHARES]
    estimates = years.select("year", F.inline(F.array(*asked)))
    wide = estimates.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "measure", F.col("share").cast("string")), "estimate"))).alias("e"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("year"), "l_extendedprice",
        F.when(F.col("l_orderkey") % 3 > 0, 1.0).otherwise(F.col("l_extendedprice")).alias("tied"), F.col("l_orderkey").cast("double").alias("ordered"),
    )
    counts = lines.join(wide, "year").groupBy("year").agg(
        F.count("*").alias("rows"),
        *[F.struct(F.count_if(F.col(m) < F.col("e")[f"{m} {s}"]).alias("below"), F.count_if(F.col(m) <= F.col("e")[f"{m} {s}"]).alias("upto")).alias(f"{m} {s}") for m in measures for s in _SHARES],
    )
    # the true ranks of an estimate run from the rows below it to those up to it
    within = lambda m, s: (F.col(f"`{m} {s}`.below") <= (s + sketches.RANK_ERROR) * F.col("rows")) & (F.col(f"`{m} {s}`.upto") >= (s - sketches.RANK_ERROR) * F.col("rows"))
    checks = [F.struct(F.lit(m).alias("measure"), F.lit(s).alias("share"), F.col("rows"), within(m, s).alias("within")) for m in measures for s in _SHARES]
    return counts.select("year", F.inline(F.array(*checks)))


# ---- spellings ------------------------------------------------------------

_WORDS = "w AS (SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM documents)"
_FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"


def _words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))


@query(
    "rank_folded",
    f"WITH {_WORDS} SELECT min(word) AS name, count(*) AS records FROM w GROUP BY {_FOLD.format('word')} ORDER BY records DESC, name LIMIT 50",
)
def rank_folded(spark, sf_dir):
    """The most frequent words, spellings with and without accents and capitals counted together."""
    return rank.rank_by_count(_words(spark, sf_dir), "word", 50, folded=True)


@query(
    "filter_folded",
    f"""WITH {_WORDS},
k AS (SELECT DISTINCT {_FOLD.format("upper(strip_accents(word))")} AS f FROM (SELECT word FROM w WHERE len(word) = 4) WHERE word LIKE 'd%')
SELECT 'listed' AS filter, word, count(*) AS records FROM w WHERE {_FOLD.format('word')} IN ('que', 'fur', 'strasse', 'et', 'uber') GROUP BY 2
UNION ALL SELECT 'table', word, count(*) FROM w WHERE {_FOLD.format('word')} IN (SELECT f FROM k) GROUP BY 2""",
)
def filter_folded(spark, sf_dir):
    """A list of values and a table of values that keep every spelling of what they name."""
    # the filters keep or drop a word whole, so each spelling is compared once, with its count
    words = shared(_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("records")))
    listed = words.where(filters.categories(words, {"word": ["QUÉ", "für", "Strasse", "ET", "Über"]}, folded=True))
    values = words.where("length(word) = 4 AND word LIKE 'd%'").select(F.upper("word").alias("value"))
    chosen = filters.in_listed(words, "word", values, folded=True)
    named = lambda df, name: df.select(F.lit(name).alias("filter"), "word", "records")
    return named(listed, "listed").unionByName(named(chosen, "table"))


# ---- counts taken while writing --------------------------------------------

_KEPT = "segment IN ('BUILDING', 'MACHINERY') AND ship_ts >= TIMESTAMP '1997-01-01' AND ship_ts <= TIMESTAMP '1998-12-31'"


@query(
    "filter_written",
    S.ctes(S.MART)
    + f""" SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_KEPT}) AS rows_after, CAST(2 AS BIGINT) AS filters_applied,
  round(CAST(sum(amount) FILTER (WHERE {_KEPT}) AS DOUBLE), 2) AS total FROM m""",
)
def filter_written(spark, sf_dir):
    """Filtered rows as a table; how many there were before and after comes from the pass that writes them."""
    mart = sales_mart(spark, sf_dir, "ship_ts", "amount", "segment")
    folder = shared_folder(spark, "filtered")
    chosen = filters.categories(mart, {"segment": ["BUILDING", "MACHINERY"]})
    report = filters.write_filtered(mart, folder, chosen, filters.date_range("ship_ts", "1997-01-01", "1998-12-31"))
    figures = [F.lit(report[name]).cast("long").alias(name) for name in ("rows_before", "rows_after", "filters_applied")]
    return spark.read.parquet(folder).agg(round_to(F.sum("amount"), 2).alias("total")).select(*figures, "total")
