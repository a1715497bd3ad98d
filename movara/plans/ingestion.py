"""Ingest decisions over whole tables: each document is treated as one delimited file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.columns import round_to
from movara.plans.registry import query
from movara.sources import ingest as I
from movara.sources.mart import table


def document_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = """l AS (
  SELECT doc_id AS file, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents
)"""
_SEPS = "(VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) AS seps(separator, so)"
_SNIFF = f"""sn0 AS (
  SELECT file, separator, so, sum(len(line) - len(replace(line, separator, ''))) AS hits
  FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= 25), {_SEPS} GROUP BY ALL
),
sn AS (SELECT file, separator, CAST(hits AS BIGINT) AS hits FROM sn0
       QUALIFY row_number() OVER (PARTITION BY file ORDER BY hits DESC, so) = 1)"""


def _norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')"
    )


def _signed(x: str) -> str:
    bare = f"regexp_replace({x}, '[^\\d,.\\-]', '', 'g')"
    return f"CASE WHEN starts_with({x}, '(') AND ends_with({x}, ')') THEN '-' || {bare} ELSE {bare} END"


_PLAIN = r"'^-?(\d+\.?\d*|\.\d+)$'"
_IS_NUMBER = rf"""CASE WHEN s IN ('', '-', '.', ',') THEN FALSE
  WHEN contains(s, ',') AND contains(s, '.') AND regexp_matches(s, ',[^.]*$') THEN regexp_matches(replace(replace(s, '.', ''), ',', '.'), {_PLAIN})
  WHEN contains(s, ',') AND contains(s, '.') THEN regexp_matches(replace(s, ',', ''), {_PLAIN})
  WHEN regexp_matches(s, '^-?\d{{1,3}}(,\d{{3}})+$') THEN TRUE
  WHEN contains(s, ',') THEN regexp_matches(replace(s, ',', '.'), {_PLAIN})
  WHEN regexp_matches(s, '^-?\d{{1,3}}(\.\d{{3}})+$') THEN TRUE
  ELSE regexp_matches(s, {_PLAIN}) END"""


def _numeric_flags(values: str) -> str:
    return f"list_transform(list_transform({values}, lambda x: {_signed('x')}), lambda s: {_IS_NUMBER})"


def _count(flags: str) -> str:
    return f"len(list_filter({flags}, lambda b: b))"


_DATE = r"(^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$)|(^\d{4}[/-]\d{1,2}[/-]\d{1,2}$)|(^\d{4}[/-]\d{1,2}$)|(^\d{1,2}[/-]\d{4}$)"
_QUARTER = r"(?i)^(q|t|tri|trim)?[1-4][\s_/-]?\d{2,4}$"
_TERMS = "|".join(I.HEADER_TERMS)

_ROWS = rf"""rw0 AS (
  SELECT file, line_no, separator, so,
         list_transform(string_split(line, separator), lambda c: nullif(regexp_replace(c, '^\s+|\s+$', '', 'g'), '')) AS cells
  FROM l, {_SEPS}
),
rw AS (
  SELECT *, list_filter(cells, lambda c: c IS NOT NULL) AS vals, row_number() OVER (PARTITION BY file, separator ORDER BY line_no) AS n
  FROM rw0 WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) > 0
),
hd0 AS (
  SELECT file, separator, so, line_no, n, cells, vals,
         coalesce(lead(vals) OVER (PARTITION BY file, separator ORDER BY n), []) AS nxt
  FROM rw WHERE n <= 13
),
hd1 AS (
  SELECT *, list_transform(vals, lambda v: {_norm('v')}) AS names, CAST(len(vals) AS DOUBLE) AS k,
         {_count(_numeric_flags('vals'))} AS numeric_cells,
         len(list_filter(vals, lambda v: regexp_matches(v, '[A-Za-z_]'))) AS text_cells,
         len(list_filter(vals, lambda v: len(v) <= 36)) AS short_cells,
         len(nxt) AS density,
         {_count(_numeric_flags('nxt'))} + len(list_filter(nxt, lambda v: (regexp_matches(v, '{_DATE}') OR regexp_matches(v, '{_QUARTER}'))
             AND NOT {_IS_NUMBER.replace("(s,", "(" + _signed("v") + ",").replace("WHEN s IN", "WHEN " + _signed("v") + " IN").replace("replace(s,", "replace(" + _signed("v") + ",").replace("contains(s,", "contains(" + _signed("v") + ",")})) AS data_like
  FROM hd0 WHERE n <= 12
),
hd2 AS (
  SELECT *, CAST(len(list_distinct(list_filter(names, lambda v: v <> ''))) AS DOUBLE) AS u,
         len(list_filter(names, lambda v: regexp_matches(v, '{_TERMS}'))) AS known FROM hd1
),
hd3 AS (
  SELECT *, k * 3 + u * 1.5::DOUBLE + known * 5 + least(density, len(vals)) * 2 + data_like * 1.5::DOUBLE + u / k * 8 + text_cells / k * 8
         + short_cells / k * 6 - numeric_cells * 4
         - CASE WHEN k <= 2 AND len(list_filter(vals, lambda v: len(v) > 28)) > 0 THEN 28.0::DOUBLE ELSE 0 END
         - CASE WHEN k < 2 THEN 20.0::DOUBLE ELSE 0 END
         - CASE WHEN u / k < 0.75::DOUBLE THEN 14.0::DOUBLE ELSE 0 END
         - CASE WHEN text_cells / k < 0.6::DOUBLE THEN 18.0::DOUBLE ELSE 0 END
         - CASE WHEN len(list_filter(vals, lambda v: len(v) > 64)) > 0 THEN 12.0::DOUBLE ELSE 0 END AS score
  FROM hd2
),
hd AS (
  SELECT *, round(greatest(0, least(1, score / 95)), 2) AS confidence FROM hd3
  QUALIFY row_number() OVER (PARTITION BY file, separator ORDER BY score DESC, n DESC) = 1
)"""

_GENERIC = f"""(lower(coalesce(h, '')) IN ('', 'nan', 'none', '<na>') OR starts_with(lower(coalesce(h, '')), 'unnamed:')
   OR starts_with({_norm('h')}, 'coluna_'))"""

_TABLES = f"""pl AS (
  SELECT rw.file, rw.separator, rw.cells, rw.line_no > hd.line_no AS body, hd.cells AS header_cells
  FROM rw JOIN hd ON hd.file = rw.file AND hd.separator = rw.separator
),
cnt AS (SELECT file, separator, count(*) AS raw_rows, count(*) FILTER (WHERE body) AS rows FROM pl GROUP BY ALL),
cx AS (SELECT file, separator, body, header_cells, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM pl),
bc AS (
  SELECT file, separator, pos, any_value(header_cells[pos]) AS h, count(*) FILTER (WHERE body) AS filled
  FROM cx WHERE cell IS NOT NULL GROUP BY file, separator, pos
),
cols AS (
  SELECT file, separator, count(*) AS source_columns, count(*) FILTER (WHERE filled > 0) AS columns, sum(filled) AS filled,
         count(*) FILTER (WHERE filled > 0 AND coalesce({_GENERIC}, TRUE)) AS generic
  FROM bc GROUP BY ALL
),
cand AS (
  SELECT hd.file, hd.separator, hd.so, hd.n - 1 AS header_index, hd.confidence, hd.text_cells, hd.numeric_cells, raw_rows, rows,
         source_columns, columns, generic,
         CASE WHEN rows = 0 OR columns = 0 THEN -1000 ELSE columns * 10 + least(rows, 500) * 0.05::DOUBLE
           + CAST(filled AS DOUBLE) / (rows * columns) * 40 + confidence * 35 - generic * 8 - CASE WHEN columns <= 1 THEN 35 ELSE 0 END END AS table_score
  FROM hd JOIN cnt USING (file, separator) JOIN cols USING (file, separator)
),
pick AS (
  SELECT cand.* FROM cand JOIN sn ON sn.file = cand.file
  QUALIFY row_number() OVER (PARTITION BY cand.file ORDER BY round(table_score, 6) DESC, CASE WHEN cand.separator = sn.separator THEN 0 ELSE so + 1 END) = 1
),
gated AS (
  SELECT *, NOT (confidence < 0.2 AND NOT (source_columns = 1 AND text_cells = 1 AND numeric_cells = 0 AND raw_rows >= 2))
     AND table_score > -1000 AS accepted FROM pick
)"""

_HEADERS_SQL = f"WITH {_LINES},\n{_ROWS}"
_PLAN_SQL = f"WITH {_LINES},\n{_SNIFF},\n{_ROWS},\n{_TABLES}"


@query("ingest_sniff", f"WITH {_LINES},\n{_SNIFF} SELECT file, separator, hits FROM sn")
def ingest_sniff(spark, sf_dir):
    return I.sniff_separators(document_lines(spark, sf_dir))


@query(
    "header_detect",
    _HEADERS_SQL
    + """ SELECT file, separator, CAST(header_index AS BIGINT) AS header_index, round(score, 4) AS score, confidence,
  CAST(text_cells AS INTEGER) AS text_cells, CAST(numeric_cells AS INTEGER) AS numeric_cells FROM (SELECT *, n - 1 AS header_index FROM hd)""",
)
def header_detect(spark, sf_dir):
    headers = I.detect_headers(document_lines(spark, sf_dir))
    return headers.select(
        "file", "separator", "header_index", round_to("score").alias("score"), "confidence", "text_cells", "numeric_cells"
    )


@query(
    "ingest_candidate_score",
    _PLAN_SQL
    + " SELECT file, separator, raw_rows, rows, source_columns, columns, generic, round(table_score, 4) AS table_score FROM cand",
)
def ingest_candidate_score(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    candidates = I.candidate_tables(I.tabular_rows(lines), I.detect_headers(lines))
    return candidates.select(
        "file", "separator", "raw_rows", "rows", "source_columns", "columns", "generic", round_to("table_score").alias("table_score")
    )


@query("header_gate", _PLAN_SQL + " SELECT file, separator, confidence, CAST(accepted AS INTEGER) AS accepted FROM gated")
def header_gate(spark, sf_dir):
    tables = I.gate(I.plan_tables(document_lines(spark, sf_dir)))
    return tables.select("file", "separator", "confidence", F.col("accepted").cast("int").alias("accepted"))


@query(
    "ingest_report",
    _PLAN_SQL
    + """ SELECT file, separator, raw_rows, CAST(header_index AS BIGINT) AS metadata_rows,
  greatest(raw_rows - header_index - 1, 0) AS expected_rows, rows AS parsed_rows, columns AS parsed_columns,
  source_columns - columns AS empty_columns_dropped, CAST(greatest(raw_rows - header_index - 1, 0) <> rows AS INTEGER) AS count_mismatch,
  CAST(generic > 0 AS INTEGER) AS generic_names, CAST(accepted AS INTEGER) AS accepted FROM gated""",
)
def ingest_report(spark, sf_dir):
    return I.ingest_report(I.plan_tables(document_lines(spark, sf_dir)))


@query(
    "ingest_plan",
    _PLAN_SQL
    + """ SELECT separator, CAST(columns AS BIGINT) AS columns, CAST(accepted AS INTEGER) AS accepted, count(*) AS files,
  CAST(sum(rows) AS BIGINT) AS rows FROM gated GROUP BY ALL""",
)
def ingest_plan(spark, sf_dir):
    tables = I.gate(I.plan_tables(document_lines(spark, sf_dir)))
    return tables.groupBy("separator", "columns", F.col("accepted").cast("int").alias("accepted")).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows")
    )


@query(
    "clean_names",
    rf"""WITH {_LINES},
x AS (SELECT file, unnest(string_split(line, ' ')) AS name, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM l WHERE line_no = 0),
y AS (SELECT file, pos, regexp_replace(name, '^\s+|\s+$', '', 'g') AS t FROM x),
z AS (SELECT file, pos, CASE WHEN lower(t) IN ('', 'nan', 'none', '<na>') OR starts_with(lower(t), 'unnamed:') THEN 'coluna_' || (pos + 1) ELSE t END AS b FROM y)
SELECT file, CAST(pos AS INTEGER) AS pos, CASE WHEN row_number() OVER w = 1 THEN b ELSE b || '_' || row_number() OVER w END AS clean_name FROM z
WINDOW w AS (PARTITION BY file, b ORDER BY pos)""",
)
def clean_names(spark, sf_dir):
    first = document_lines(spark, sf_dir).where("line_no = 0")
    names = first.select("file", F.posexplode(F.split("line", " ")).alias("pos", "name"))
    return I.clean_names(names, ["file"], "pos", "name")


@query(
    "header_in_data",
    rf"""WITH {_LINES},
f AS (SELECT file, list_filter(list_transform(string_split(line, ' '), lambda c: nullif(regexp_replace(c, '^\s+|\s+$', '', 'g'), '')), lambda c: c IS NOT NULL) AS v
  FROM l WHERE line_no = 0),
t AS (SELECT file, v, list_filter(v, lambda c: regexp_matches(c, '[A-Za-zÀ-ÿ_]')) AS texts FROM f)
SELECT file, CAST(len(v) >= 2 AND len(texts) >= 2 AND len(list_filter(v, lambda c: TRY_CAST(c AS DOUBLE) IS NOT NULL)) <= greatest(1, len(v) // 3)
  AND len(list_filter(texts, lambda c: regexp_matches({_norm('c')}, 'data|mes|trim|produto|cliente|fornecedor|valor|receita|venda|compra'))) >= 1 AS INTEGER) AS header_like FROM t""",
)
def header_in_data(spark, sf_dir):
    first = document_lines(spark, sf_dir).where("line_no = 0")
    cells = I.clean_cells(I.split_cells(F.col("line"), " "))
    return I.header_in_data(first.select("file", cells.alias("cells")), "file", "cells")


# A line read character by character. States: 0 a cell begins, 1 inside a plain cell, 2 inside quotes, 3 after a quote inside quotes.
# ``o`` is the text with dividing separators marked; ``q`` is the same if the quote that opened the cell never closes, ``t`` the state there.
_PLAIN_CHAR = """CASE WHEN c = sep THEN {'s': 0, 'o': a.o || chr(30), 't': 0, 'q': ''} ELSE {'s': 1, 'o': a.o || c, 't': 0, 'q': ''} END"""
_CELL_STEP = f"""CASE
  WHEN a.s = 0 AND c = '"' THEN {{'s': 2, 'o': a.o, 't': 1, 'q': a.o || c}}
  WHEN a.s IN (0, 1) OR (a.s = 3 AND c <> '"') THEN {_PLAIN_CHAR}
  ELSE {{'s': CASE WHEN c = '"' AND a.s = 2 THEN 3 ELSE 2 END,
        'o': CASE WHEN c = '"' AND a.s = 2 THEN a.o ELSE a.o || c END,
        't': CASE WHEN a.t = 2 OR (a.t = 3 AND c = '"') THEN CASE WHEN a.t = 2 AND c = '"' THEN 3 ELSE 2 END
                  WHEN a.t = 0 AND c = '"' THEN 2 WHEN c = sep THEN 0 ELSE 1 END,
        'q': CASE WHEN (a.t = 0 OR a.t = 2) AND c = '"' THEN a.q WHEN a.t < 2 AND c = sep THEN a.q || chr(30)
                  WHEN a.t = 3 AND c = sep THEN a.q || chr(30) ELSE a.q || c END}} END"""


@query(
    "cell_tokens",
    f"""WITH lines AS (
  SELECT 'documents' AS "table", doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
  UNION ALL SELECT 'pages', page_id, unnest(string_split(html, chr(10))), generate_subscripts(string_split(html, chr(10)), 1) - 1 FROM pages
),
read AS (SELECT "table", id, line_no, sep, list_reduce(string_split(line, ''), lambda a, c: {_CELL_STEP}, {{'s': 0, 'o': '', 't': 0, 'q': ''}}) AS f, line
         FROM lines, (VALUES (','), (';'), (chr(9)), ('|')) AS seps(sep)),
cells AS (SELECT "table", id, line_no, sep, CASE WHEN line = '' THEN '' WHEN f.s = 2 THEN f.q ELSE f.o END AS cells FROM read)
SELECT "table", id, CAST(line_no AS INTEGER) AS line_no, sep AS separator, CAST(len(string_split(cells, chr(30))) AS INTEGER) AS n_cells, md5(cells) AS cells_md5 FROM cells""",
)
def cell_tokens(spark, sf_dir):
    """Every line of the documents and of the pages' sources, cut at each separator."""
    split = lambda text: F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    lines = table(spark, sf_dir, "documents").select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), split("text")).unionByName(
        table(spark, sf_dir, "pages").select(F.lit("pages").alias("table"), F.col("page_id").alias("id"), split("html"))
    )
    readings = F.array(*[F.struct(F.lit(s).alias("separator"), I.split_cells(F.col("line"), s).alias("cells")) for s in I.SEPARATORS])
    digest = F.md5(F.array_join("cells", "\x1e").cast("binary"))
    return lines.select("table", "id", "line_no", F.inline(readings)).select(
        "table", "id", "line_no", "separator", F.size("cells").alias("n_cells"), digest.alias("cells_md5")
    )


_DATE_COLUMNS = {
    "data_pedido": ("F", "strftime(o_orderdate, '%d/%m/%Y')"),
    "emissao": ("F", "strftime(o_orderdate, '%Y-%m-%d')"),
    "competencia_fiscal": ("F", "strftime(o_orderdate, '%Y-%m')"),
    "clerk_note": ("F", "o_orderpriority"),
    "codes": ("F", "CAST(o_orderkey AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) || '/x'"),
}


def dated_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("data_pedido"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("emissao"),
        F.date_format("o_orderdate", "yyyy-MM").alias("competencia_fiscal"),
        F.col("o_orderpriority").alias("clerk_note"),
        F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("x")).alias("codes"),
    )


_PATTERNS = (_DATE.split("|")[0], *_DATE.split("|")[1:])


def _date_like_sql() -> str:
    parts = []
    for name, (_, expr) in _DATE_COLUMNS.items():
        by_name = int(name in ("data_pedido", "competencia_fiscal"))
        shares = ", ".join(f"avg(regexp_matches({expr}, '{p}')::INT)" for p in _PATTERNS)
        parts.append(
            f"""SELECT '{name}' AS "column", {by_name} AS by_name, CAST({by_name} = 1 OR greatest({shares}) >= 0.8 AS INTEGER) AS date_like FROM orders"""
        )
    return " UNION ALL ".join(parts)


@query("date_like_cols", _date_like_sql())
def date_like_cols(spark, sf_dir):
    return I.date_like_columns(dated_orders(spark, sf_dir))
