"""Cell-level cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.text import blank_to_null


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[blank_to_null(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    )


def drop_empty_report(df: DataFrame) -> DataFrame:
    """Rows read, rows with any value, and columns with any value."""
    clean = blanks_to_null(df)
    filled = F.coalesce(*[F.col(c).cast("string") for c in clean.columns]).isNotNull()
    columns = sum(((F.count(c) > 0).cast("bigint") for c in clean.columns), F.lit(0).cast("bigint"))
    return clean.agg(
        F.count("*").alias("rows_read"), F.count_if(filled).alias("rows_kept"), columns.alias("columns_kept")
    )


def drop_empty(df: DataFrame) -> DataFrame:
    """Blank cells to null, then without all-null rows and columns.

    Which columns are empty decides the schema, so it is one aggregate whose single row
    (a flag per column) is read by the driver.
    """
    clean = blanks_to_null(df)
    flags = clean.agg(*[(F.count(c) > 0).alias(c) for c in clean.columns]).first()
    return clean.select(*[c for c in clean.columns if flags[c]]).dropna(how="all")
