"""From a folder of messy files to typed tables.

Rows of all files are keyed by the fingerprint of their header and written once, partitioned by it, every cell as its text and
as the number that it reads as. What each column is (empty, a number, a date kept as text, text) is settled from the
written table, for all headers in one aggregate; a table is then the rows of one fingerprint, under clean names and with one
of the two readings of each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from movara.functions.columns import first_match
from movara.functions.dates import parse_date
from movara.functions.names import ROLES
from movara.functions.numbers import parse_number
from movara.functions.text import normalize
from movara.sources.ingest import COERCION_RATIO, DATE_CELLS, clean_names


def fingerprint(header: Column) -> Column:
    """Equal for equal headers, cell by cell; nulls count."""
    return F.md5(F.to_json(F.transform(header, lambda c: F.coalesce(c, F.lit("")))).cast("binary"))


def write_rows(body: DataFrame, folder: str, strict: bool = False) -> dict[str, int]:
    """``body`` (``file``, ``header_cells``, ``cells``) as one table partitioned by header; what was written, counted by the write itself.

    ``strict`` reads no number in a cell with letters, so that a label that ends in digits stays text.
    """
    cells = F.transform("cells", lambda c: F.struct(c.alias("text"), parse_number(c, strict).alias("number")))
    rows = body.select("file", F.col("header_cells").alias("header"), cells.alias("cells"), fingerprint(F.col("header_cells")).alias("layout"))
    seen = Observation("rows")
    missing = F.size(F.filter("cells", lambda c: c["text"].isNull()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = rows.observe(seen, F.count("*").alias("rows"), total(F.size("cells")).alias("cells"), total(missing).alias("missing_cells"))
    counted.write.partitionBy("layout").parquet(folder)
    return dict(seen.get)


def column_facts(rows: DataFrame) -> DataFrame:
    """One row a (``layout``, ``pos``): clean name, filled cells and ``kind`` (``empty``, ``number``, ``date``, ``text``).

    A column is a number where at least four fifths of its cells read as one, unless its name says identifier or it holds dates:
    by its name, by a common shape, or because its marked texts parse.
    """
    text = F.col("cell.text")
    there = text.isNotNull()
    share = lambda test: F.coalesce(F.avg(F.when(there, F.coalesce(test, F.lit(False)).cast("double"))), F.lit(0.0))
    cells = rows.select("layout", "header", F.posexplode("cells").alias("pos", "cell"))
    measured = cells.groupBy("layout", "pos").agg(
        F.first(F.get("header", F.col("pos")), ignorenulls=True).alias("name"),
        F.count(text).alias("filled"),
        share(F.col("cell.number").isNotNull()).alias("numbers"),
        F.greatest(*[share(text.rlike(p)) for p in DATE_CELLS]).alias("shaped"),
        share(text.rlike("[/-]")).alias("marked"),
        share(parse_date(text).isNotNull()).alias("month_first"),
        share(parse_date(text, True).isNotNull()).alias("day_first"),
    )
    named = measured.join(clean_names(measured.select("layout", "pos", "name"), ["layout"], "pos", "name"), ["layout", "pos"])
    role = lambda name: F.coalesce(normalize("clean_name").rlike(ROLES[name]), F.lit(False))
    parsed = F.when(F.col("month_first") < 0.5, F.col("day_first")).otherwise(F.col("month_first"))
    dated = role("date") | (F.col("shaped") >= 0.8) | ((F.col("marked") >= 0.8) & (parsed >= 0.8))
    kind = first_match(
        (F.col("filled") == 0, "empty"), (dated, "date"), (role("identifier"), "text"), (F.col("numbers") >= COERCION_RATIO, "number"), default="text"
    )
    return named.select("layout", "pos", F.col("clean_name").alias("name"), "filled", kind.alias("kind"))


def typed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each header's table: numbers as doubles, all else as text, without empty columns; short rows are padded with null.

    The facts of the columns, one row a column of a header, come to the driver, because they are the schemas.
    """
    rows = spark.read.parquet(folder)
    layouts: dict[str, list] = {}
    for fact in column_facts(rows).orderBy("layout", "pos").collect():
        layouts.setdefault(fact.layout, []).append(fact)
    tables = {}
    for layout, facts in layouts.items():
        cell = lambda f: F.get("cells", F.lit(f.pos))["number" if f.kind == "number" else "text"].alias(f.name)
        tables[layout] = rows.where(F.col("layout") == layout).select(*[cell(f) for f in facts if f.kind != "empty"])
    return tables
