"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from movara.plans.catalog import QUERIES

HEADLINE = [
    "monthly_comparison",
    "monthly_drivers",
    "comparative_cards",
    "abnormal_periods",
    "rank_sum_desc",
    "rank_top8_share",
    "facet_counts",
    "filter_category",
    "distinct_count",
    "root_cause",
    "impact_ranking",
    "waterfall",
    "export_dimension",
    "numeric_summary",
    "duplicate_rows",
    "quality_score",
    "column_types",
    "parse_number",
    "parse_period",
    "normalize_text",
    "dedupe_norm",
    "header_detect",
    "ingest_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["shape"](spark, sf_dir).collect()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query finds what another one has kept
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
