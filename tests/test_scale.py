"""Steps that see each value once, or less of it: same results, and plans that show it."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from movara.functions.columns import exact_sum
from movara.functions.text import normalize
from movara.operators import rank, roles
from movara.sources import ingest
from tests.test_ingest import plain_cells


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_sum_without_wide_fractions(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(500)] + [1e-9, 2.0**53, -(2.0**53), 1e20, -1e20, 0.5, -0.5]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = float(sum(map(Decimal, values)))
    got = [rows.repartition(n).agg(exact_sum("v").alias("s")).first().s for n in (1, 7)]
    assert got[0] == got[1] and abs(got[0] - want) <= 1e-6
    ends = lambda vs: spark.createDataFrame([(v,) for v in vs], "v double").agg(exact_sum("v").alias("s")).first().s
    assert ends([None]) is None and str(ends([1.0, float("nan")])) == "nan" and ends([1.0, float("inf")]) == float("inf")
    assert ends([1e30, 1.0]) == 1e30 and ends([0.1] * 10) == 1.0
    assert "decimal(38,18)" not in plan(rows.agg(exact_sum("v")))


def test_folded_ranking_folds_each_spelling_once(spark):
    words = spark.createDataFrame([("É",), ("e",), ("E",), ("b",), (None,), ("é",)], "word string")
    top = rank.rank_by_count(words, "word", folded=True)
    assert [tuple(r) for r in top.collect()] == [("E", 4), ("b", 1)]
    assert plan(top).count("Aggregate") == 2


def test_candidate_rows_carry_places(spark):
    lines = spark.createDataFrame([(f, n, t) for f in (1, 2) for n, t in enumerate(["a,b;c", "", "1,2", ",x", "3,,4"])], "file long, line_no int, line string")
    tables = ingest.candidate_tables(ingest.tabular_rows(lines), ingest.detect_headers(lines))
    comma = tables.where("file = 1 AND separator = ','").first()
    assert (comma.raw_rows, comma.rows, comma.source_columns, comma.columns) == (4, 3, 3, 3) and comma.generic == 1
    joined = plan(tables).split("Join")
    assert any("places" in part.split("\n")[1] for part in joined[1:])


def test_year_parts_parse_once(spark):
    rows = spark.createDataFrame([("2020", "jan")] * 5 + [("2021", "fev")] * 4 + [(None, "x")], "ano string, mes string")
    axis = roles.time_axis(rows, roles.profile(rows))
    assert tuple(axis.first()) == ("ano + mes", 0.9)
    years = spark.createDataFrame([("2020", "a1", "jan")] * 7 + [("x", "2019", "fev")] * 3, "safra string, nota string, mes string")
    assert roles.year_column(years, "mes") == "safra" and roles.year_column(years.where("false"), "mes") is None
    assert "copies" in plan(axis)


def test_names_fold_in_one_replacement(spark):
    words = spark.createDataFrame([("__A--É _b_",), ("½ ß_€",), ("",), (None,)], "w string")
    under = words.select(normalize("w").alias("n"), normalize("w", " ").alias("s"))
    assert [tuple(r) for r in under.collect()] == [("a_e_b", "__a e _b_"), ("1_2", "1 2 _"), ("", ""), (None, None)]
    assert plan(under.select("n")).count("regexp_replace") == 1


#: One line under several readings, lines blank under some separators only, quoted ones, repeated line numbers.
MIXED = ["a,b;c", ";;", ',""', '"x;y",2', " ", "1|2|3", "nota;valor", '" "', "\t|\t", "valor,data,,", ",,1", '"a""b', "plain text"]


def mixed_lines(spark, seed):
    rng = random.Random(seed)
    rows = [(f, n, rng.choice(MIXED)) for f in range(8) for n in range(rng.choice((3, 20, 60)))]
    rows += [(100, n // 4, line) for n, line in enumerate(["nota;valor"] * 4 + ["1;2"] * 60)]
    return rows, spark.createDataFrame(rows, "file long, line_no int, line string")


def test_lines_are_ranked_before_they_are_read(spark):
    """A line moves once to its file's first lines, not once a separator, and the same cells are looked at once."""
    rows, lines = mixed_lines(spark, 3)
    headers = ingest.detect_headers(lines)
    assert "Generate" not in plan(headers).split("Window")[-1]
    read = {(r.file, r.line_no, r.separator): r.cells for r in ingest.tabular_rows(lines.where("file < 100")).collect()}
    want = {}
    for f, n, line in rows:
        for s in ingest.SEPARATORS:
            cells = [c.strip() or None for c in plain_cells(line, s)]
            if f < 100 and any(cells):
                want[f, n, s] = cells
    assert read == want
    alone = ingest.readings(spark.createDataFrame([(1, 0, "one cell"), (1, 1, "a,b")], "file long, line_no int, line string"))
    assert sorted((r.line_no, len(r.separators), r.cells) for r in alone.collect()) == [(0, 4, ["one cell"]), (1, 1, ["a", "b"]), (1, 3, ["a,b"])]
    chosen = {(r.file, r.separator): r for r in headers.collect()}
    for (f, s), r in chosen.items():
        if f < 100:
            numbers = sorted(n for g, n, t in want if (g, t) == (f, s))
            assert r.header_index < 12 and numbers[r.header_index] == r.header_line and r.header_cells == want[f, r.header_line, s]


def test_candidates_are_counted_before_they_meet_headers(spark):
    """Rows of all lines are counted by place; the rows down to the header, which may share its line number, are taken off."""
    rows, lines = mixed_lines(spark, 5)
    headers = ingest.detect_headers(lines)
    tables = ingest.candidate_tables(ingest.tabular_rows(lines), headers)
    assert plan(tables).count("Join") == 1
    starts = {(r.file, r.separator): r.header_line for r in headers.collect()}
    got = {(r.file, r.separator): (r.raw_rows, r.rows, r.source_columns, r.columns, r.filled) for r in tables.collect()}
    want = {}
    for (f, s), start in starts.items():
        cells = [(n, [c.strip() for c in plain_cells(line, s)]) for g, n, line in rows if g == f]
        cells = [(n, row) for n, row in cells if any(row)]
        below = [row for n, row in cells if n > start]
        places = lambda rows: {i for row in rows for i, c in enumerate(row) if c}
        total = sum(1 for row in below for c in row if c)
        want[f, s] = (len(cells), len(below), len(places([row for _, row in cells])), len(places(below)), total)
    assert got == want
