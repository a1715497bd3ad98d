"""Month states, comparison under a collation, observed writes, packages, typed tables, JSON of any shape."""

import random

import pytest
from pyspark.sql import functions as F

from movara.functions.numbers import parse_number
from movara.operators import filters, rank, sketches
from movara.operators.export import read_package, write_package
from movara.sources import ingest as I
from movara.sources.typed import column_facts, typed_tables, write_rows


def test_month_states(spark):
    draw = random.Random(5)
    rows = [(f"2024-{m:02d}", draw.randrange(3000), draw.choice([1.0, 1.0, draw.random() * m, float("nan"), None])) for m in range(1, 7) for _ in range(2000)]
    frame = spark.createDataFrame(rows + [("2024-07", None, None)], "month string, code int, value double")
    states = sketches.month_states(frame, "month", ["code"], ["value"])
    assert states.count() == 7
    for first, last in ((1, 6), (2, 3), (7, 7)):
        span = states.where(F.substring("month", 6, 2).cast("int").between(first, last)).withColumn("span", F.lit(1))
        got = sketches.merged(span, "span").select(
            sketches.distinct_estimate("code").alias("n"), *[sketches.quantile_estimate("value", s).alias(f"q{s}") for s in (0.0, 0.5, 1.0)]
        ).first()
        own = [r for r in rows if first <= int(r[0][5:]) <= last]
        exact = len({r[1] for r in own})
        assert abs(got.n - exact) <= max(1, exact * sketches.DISTINCT_ERROR)
        values = sorted(r[2] for r in own if r[2] is not None and r[2] == r[2])
        if not values:
            assert got["q0.5"] is None
            continue
        assert got["q0.0"] == values[0] and got["q1.0"] == values[-1]
        below, upto = sum(v < got["q0.5"] for v in values), sum(v <= got["q0.5"] for v in values)
        assert below / len(values) <= 0.5 + sketches.RANK_ERROR and upto / len(values) >= 0.5 - sketches.RANK_ERROR


def test_spellings_are_one_group(spark):
    rows = [("São Paulo", 1), ("SAO PAULO", 2), ("sao paulo", 4), ("Rio", 8), (None, 16), ("Straße", 32), ("STRASSE", 64)]
    frame = spark.createDataFrame(rows, "city string, amount int")
    assert [tuple(r) for r in rank.rank_by_sum(frame, "city", "amount", folded=True).collect()] == [("STRASSE", 96.0), ("Rio", 8.0), ("SAO PAULO", 7.0)]
    assert rank.rank_by_count(frame, "city").count() == 5
    chosen = filters.categories(frame, {"city": ["sáo paulo", " "]}, folded=True)
    assert sorted(r.amount for r in frame.where(chosen).collect()) == [1, 2, 4]
    listed = spark.createDataFrame([("RIO",), (None,), ("strasse",)], "name string")
    assert sorted(r.amount for r in filters.in_listed(frame, "city", listed, folded=True).collect()) == [8, 32, 64]
    assert filters.in_listed(frame, "city", listed).count() == 0


def test_counts_come_from_the_write(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(30)], "id int, kind string")
    report = filters.write_filtered(frame, f"{tmp_path}/out", F.col("kind") == "a", F.col("id") < 15)
    assert report == {"rows_before": 30, "rows_after": 10, "filters_applied": 2}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_package_replaces_only_its_partitions(spark, tmp_path):
    months = spark.createDataFrame([("2023-12", 2023, 1.5), ("2024-01", 2024, 2.5)], "period string, year int, value double")
    names = spark.createDataFrame([("a, \"b\"", None), ("ü", 3)], "name string, n long")
    write_package({"months": months, "names": names}, f"{tmp_path}/p", {"months": ["year"]}, {"metric": "value"})
    write_package({"months": months.where("year = 2024").withColumn("value", F.lit(9.0))}, f"{tmp_path}/p", {"months": ["year"]})
    got = read_package(spark, f"{tmp_path}/p")
    assert [tuple(r) for r in got["months"].orderBy("period").collect()] == [("2023-12", 2023, 1.5), ("2024-01", 2024, 9.0)]
    entry = got["manifest"].first()
    assert (entry.table, entry.rows, entry.partitions) == ("months", 1, ["year"])
    write_package({"names": names}, f"{tmp_path}/q", about={"metric": "value"})
    again = read_package(spark, f"{tmp_path}/q")
    assert {tuple(r) for r in again["names"].collect()} == {("a, \"b\"", None), ("ü", 3)} and again["names"].schema == names.schema
    assert again["manifest"].first().about == {"metric": "value"}


def test_typed_tables(spark, tmp_path):
    body = [
        ("f1", ["codigo", "valor", None, "data", "valor"], ["1", "R$ 1.234,50", None, "01/02/2024", "x"]),
        ("f2", ["codigo", "valor", None, "data", "valor"], ["2", "(3,25)", None, "02/02/2024", None]),
        ("f2", ["codigo", "valor", None, "data", "valor"], ["3", "7", None, None]),
        ("f3", ["nome"], ["Cliente 12", "extra"]),
    ]
    frame = spark.createDataFrame(body, "file string, header_cells array<string>, cells array<string>")
    seen = write_rows(frame, f"{tmp_path}/rows", strict=True)
    assert seen == {"rows": 4, "cells": 16, "missing_cells": 5}
    tables = {tuple(t.columns): t for t in typed_tables(spark, f"{tmp_path}/rows").values()}
    sold = tables["codigo", "valor", "data", "valor_2"]
    assert dict(sold.dtypes) == {"codigo": "string", "valor": "double", "data": "string", "valor_2": "string"}
    assert sorted(r.valor for r in sold.collect()) == [-3.25, 7.0, 1234.5]
    assert [tuple(r) for r in tables["nome", "coluna_2"].collect()] == [("Cliente 12", "extra")]
    facts = {r.name: r.kind for r in column_facts(spark.read.parquet(f"{tmp_path}/rows")).collect()}
    assert facts["coluna_3"] == "empty" and facts["data"] == "date"


def test_strict_numbers(spark):
    texts = ["R$ 1.234,50", "Cliente 12", "12 kg", "EUR 5", "euro 5", "-3", "(2)", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in frame.select(parse_number("t", strict=True).alias("n")).collect()] == [1234.5, None, None, 5.0, None, -3.0, -2.0, None]


def test_json_of_any_shape(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text('[\n{"a": 1, "b": "x"}, {"a": 2.5},\n null]')
    (tmp_path / "deep" / "b.json").write_text('{"a": "text", "c": {"d": [1]}}\nbroken{\n{"a": 4}\n')
    (tmp_path / "empty.json").write_text("")
    records = I.json_records(spark, str(tmp_path))
    assert records.count() == 6
    got = I.json_table(records, {"a": "double", "b": "string", "c": "struct<d: array<int>>"}, "array").collect()
    assert sorted(r.a for r in got if r.a is not None) == [1.0, 2.5, 4.0]
    assert [r.c.d for r in got if r.c] == [[1]] and sum(r.array for r in got) == 3
    shapes = {r["array"]: (r["schema"], r["records"]) for r in I.json_schema(records).collect()}
    assert "a:" in shapes[True][0] and shapes[False][1] == 3
    (tmp_path / "none").mkdir()
    assert I.json_records(spark, f"{tmp_path}/none").count() == 0
