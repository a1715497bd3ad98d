import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from movara.operators import filters, quality, stats


def test_exact_quantiles_under_skew(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET", 0.01)
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(20000, 3.5), rng.lognormal(3, 2, 40000).round(3)])
    df = spark.createDataFrame(pd.DataFrame({"a": np.sort(values), "b": rng.permutation(values) * -1})).repartition(6)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = {(r.column, r.q): r.value for r in stats.exact_quantiles(df, ["a", "b"], qs).collect()}
    for q in qs:
        assert got[("a", q)] == pytest.approx(np.quantile(values, q))
        assert got[("b", q)] == pytest.approx(np.quantile(-values, q))


def test_outlier_rules(spark):
    rows = [(10.0, 1.0, 1.0), (100.0, 1.0, 2.0), (200.0, 1.0, 3.0), (300.0, 9.0, 4.0), (400.0, 1.0, 100.0)]
    df = spark.createDataFrame(rows, "by_ratio double, flat double, by_iqr double")
    got = {r.column: (r.rule, r.outliers) for r in quality.outlier_counts(df).collect()}
    assert got == {"by_ratio": ("ratio", 1), "by_iqr": ("iqr", 1)}
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    detail = quality.outlier_details(keyed, "k", ["by_ratio", "by_iqr"]).collect()
    assert {(r.column, r.value) for r in detail} == {("by_ratio", 10.0), ("by_iqr", 100.0)}


def test_duplicates_and_score(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "a", None), (2, None, None)]
    df = spark.createDataFrame(rows, "n int, t string, e string")
    assert stats.duplicate_rows(df).first()[0] == 2
    scored = quality.quality_score(df).first()
    assert (scored.missing_total, scored.empty_columns, scored.duplicate_rows) == (5, 1, 2)
    assert scored.outliers == 1  # 2 lies outside the quartiles 1 and 1.25
    assert scored.score == round(100 - (round(5 / 12 * 45, 2) + 12.5 + round(20 / 3, 2) + 2.5))


def test_filters(spark):
    rows = [("2024-01-01 00:00:00", "x"), ("2024-01-02 09:00:00", "y"), (None, "x")]
    df = spark.createDataFrame(rows, "t string, k string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert df.where(filters.date_range("t", "2024-01-01", "2024-01-02")).count() == 1
    assert df.where(filters.date_range("t", "nonsense", None)).count() == 3
    assert df.where(filters.categories(df, {"k": ["x", " "], "zz": ["q"]})).count() == 2


def test_nan_tiny_and_huge_values(spark):
    rows = spark.createDataFrame([(1.0, 0.00004, 1e26), (float("nan"), 0.00004, 1e26), (3.0, 1e-12, -1e26)], "a double, b double, c double")
    got = {r.column: r for r in stats.numeric_stats(rows).collect()}
    assert (got["a"]["count"], got["a"]["sum"], got["a"]["mean"], got["a"]["max"]) == (2, 4.0, 2.0, 3.0)
    assert got["b"]["sum"] == 0.0001 and got["c"]["sum"] == 1e26
    assert {r.column: r.missing for r in stats.missing_counts(rows).collect()} == {"a": 1, "b": 0, "c": 0}
    summary = {r.column: r for r in stats.numeric_summary(rows).collect()}
    assert summary["a"]["mean"] == 2.0 and summary["a"]["q75"] == 2.5 and summary["c"]["max"] == 1e26


def test_quantiles_of_ordered_values(spark):
    import numpy as np

    values = np.sort(np.random.default_rng(1).normal(size=50_000))
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(4)
    wanted = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {r.q: r.value for r in stats.exact_quantiles(rows, ["v"], wanted).collect()}
    assert all(abs(got[q] - np.quantile(values, q)) < 1e-12 for q in wanted)
    few = spark.createDataFrame([(float(v),) for v in range(7)], "v double").repartition(5)
    got = {r.q: r.value for r in stats.exact_quantiles(few, ["v"], wanted).collect()}
    assert all(abs(got[q] - np.quantile(np.arange(7.0), q)) < 1e-12 for q in wanted)
