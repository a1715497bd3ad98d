"""Star-schema mart over the given tables, with join pruning."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movara.functions.dates import month_period

# Each lookup is a left join on the unique key of the right table, so leaving an
# unused one out never changes the rows. Spark decides broadcast or shuffle by size.
LOOKUPS = {
    "part": ("lineitem", "l_partkey", "p_partkey"),
    "supplier": ("lineitem", "l_suppkey", "s_suppkey"),
    "orders": ("lineitem", "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"),
    "nation": ("customer", "c_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
}

COLUMNS = {
    "order_id": ("lineitem", F.col, "l_orderkey"),
    "ship_ts": ("lineitem", F.col, "l_shipdate"),
    "period": ("lineitem", month_period, "l_shipdate"),
    "amount": ("lineitem", lambda c: F.col(c).cast("decimal(18,2)"), "l_extendedprice"),
    "quantity": ("lineitem", F.col, "l_quantity"),
    "discount": ("lineitem", F.col, "l_discount"),
    "tax": ("lineitem", F.col, "l_tax"),
    "margin_rate": ("lineitem", lambda c: 1 - F.col(c), "l_discount"),
    "return_flag": ("lineitem", F.col, "l_returnflag"),
    "line_status": ("lineitem", F.col, "l_linestatus"),
    "product_type": ("part", F.col, "p_type"),
    "brand": ("part", F.col, "p_brand"),
    "product": ("part", F.col, "p_name"),
    "supplier": ("supplier", F.col, "s_name"),
    "order_status": ("orders", F.col, "o_orderstatus"),
    "priority": ("orders", F.col, "o_orderpriority"),
    "segment": ("customer", F.col, "c_mktsegment"),
    "customer": ("customer", F.col, "c_name"),
    "nation": ("nation", F.col, "n_name"),
    "region": ("region", F.col, "r_name"),
}


@dataclass(frozen=True)
class AnalysisSpec:
    """What to analyse: one measure over months, cut by dimensions, with supporting measures.

    ``date`` names the date column that ``period`` comes from, where the rows still have it: single months are then
    read by a range of dates, which reaches the files.
    """

    metric: str = "amount"
    period: str = "period"
    dimensions: tuple[str, ...] = ("product_type", "segment", "region", "brand")
    date: str | None = None
    supports: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "quantity": ("quantity", "sum"),
            "discount": ("discount", "mean"),
            "margin_rate": ("margin_rate", "mean"),
        }
    )

    @property
    def support_columns(self) -> list[str]:
        return [column for column, _ in self.supports.values()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path_to(name: str) -> list[str]:
    path = []
    while name != "lineitem":
        path.insert(0, name)
        name = LOOKUPS[name][0]
    return path


def sales_mart(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line-item facts with only the lookups that the requested columns need."""
    columns = columns or tuple(COLUMNS)
    needed: list[str] = []
    for column in columns:
        for step in _path_to(COLUMNS[column][0]):
            if step not in needed:
                needed.append(step)
    df = table(spark, sf_dir, "lineitem")
    for name in needed:
        _, foreign, key = LOOKUPS[name]
        df = df.join(table(spark, sf_dir, name), F.col(foreign) == F.col(key), "left")
    return df.select(*[make(source).alias(column) for column in columns for _, make, source in [COLUMNS[column]]])


def dirty_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Line items with injected defects: nulls, NaN, outliers, negatives, an empty column, repeated rows."""
    key = lambda name, n: F.col(name) % n == 0
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.when(~key("l_partkey", 7), F.col("l_quantity")).alias("quantity"),
        F.when(key("l_orderkey", 997), price * 40).otherwise(price).alias("price"),
        F.when(key("l_orderkey", 983), float("nan")).when(key("l_partkey", 9), -price).otherwise(price).alias("net"),
        F.when(key("l_orderkey", 5), 9.0).otherwise(1.0).alias("flat"),
        F.when(~key("l_suppkey", 11), F.col("l_returnflag")).alias("flag"),
        F.when(~key("l_partkey", 13), F.col("l_linestatus")).alias("status"),
        F.lit(None).cast("string").alias("note"),
        *extra,
    )
    return rows.unionByName(rows.where(key("l_orderkey", 50)))
