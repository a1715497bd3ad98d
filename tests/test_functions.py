from pyspark.sql import functions as F

from movara.functions import dates as D
from movara.functions import labels as L
from movara.functions import numbers as N
from movara.functions import text as T
from movara.functions.names import named_as


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_accents_and_names(spark):
    texts = ["Nº_NF", "Ação  Média!", "ﬁm ½ x", "", None, "é"]
    assert column(spark, texts, T.strip_accents) == ["No_NF", "Acao  Media!", "fim 1⁄2 x", "", None, "e"]
    assert column(spark, texts[:2], T.normalize) == ["no_nf", "acao_media"]
    assert column(spark, ["Custo (R$/TON)"], lambda c: T.normalize(c, " ")) == ["custo r ton"]
    assert column(spark, ["Custo (R$/TON)"], T.slug) == ["custo_r_ton"]
    assert T.normalize_name("Nº_NF") == "no_nf"
    assert named_as("identifier", "Nº_NF") and named_as("identifier", "ID Cliente")
    assert not named_as("identifier", "Receita Total")
    assert named_as("noise", "Prazo Dias") and named_as("adjustment", "Desconto (%)")


def test_folding_in_every_script(spark):
    import unicodedata

    texts = ["\U0001d400bc", "\ufdfa", "\u0e34\u0e01", "\u0941x", "\ud55c\uae00", "½ ﬁ ĳ", "a\u0301b\u0345", "x\U0001f600y", "Åﬀ\u00a8"]
    texts += ["".join(chr(c) for c in range(lo, lo + 512) if not 0xD800 <= c <= 0xDFFF) for lo in range(0x80, 0x20000, 512)]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert column(spark, texts, T.strip_accents) == want
    plain = [t for t in texts[:9] if t.strip()]
    assert column(spark, plain, T.normalize) == [T.normalize_name(t) for t in plain]


def test_locale_numbers(spark):
    texts = ["R$ 1.234,56", "1,234.56", "(1.234,56)", "12%", "1.234", "0.125", "Cliente 12", "-", "", "1,5", "1.2.3", None]
    expected = [1234.56, 1234.56, -1234.56, 12.0, 1234.0, 125.0, 12.0, None, None, 1.5, None, None]
    assert column(spark, texts, N.parse_number) == expected
    assert column(spark, ["Cliente 12", "1,5"], lambda c: N.parse_number(c, strict=True)) == [None, 1.5]
    shown = column(spark, [1234.5, 1234.0, 0.5, None, 12345.678], N.format_ptbr, "double")
    assert shown == ["1.234,50", "1.234", "0,50", None, "12.345,68"]
    assert column(spark, [12345.678, 12.5], lambda c: N.format_ptbr(c, compact=True), "double") == ["12.346", "12,50"]


def test_periods(spark):
    texts = [
        "jan/2024", "marco-24", "Q1/2025", "2025-T3", "1T25", "01-JAN", "2024-03", "03/2024", "Março 2024",
        "foo/2024", "2024-13", "trim4-99", "99/2024", "", None,
    ]
    months = column(spark, texts, lambda c: D.month_period(D.parse_period(c)))
    assert months == [
        "2024-01", "2024-03", "2025-01", "2025-07", "2025-01", "2000-01", "2024-03", "2024-03", "2024-03",
        None, None, "1999-10", None, None, None,
    ]


def test_unix_and_years(spark):
    days = column(spark, ["1704067200", "1704067200000", "12"], lambda c: F.date_format(D.parse_unix(c), "yyyy-MM-dd"))
    assert days == ["2024-01-01", "2024-01-01", None]
    assert column(spark, ["FY24", "ano 1998", "2024.0", "24", "fy99"], D.year_number) == [2024, 1998, 2024, None, 1999]
    assert column(spark, ["JAN", "02", "13 dez", "x", "Março"], D.month_number) == [1, 2, 12, None, 3]


def test_day_first_is_a_column_decision(spark):
    rows = spark.createDataFrame([("05/01/2024",), ("25/12/2023",), ("2024-02-03 10:20",)], "v string")
    got = rows.select(F.date_format(D.parse_dates(rows, "v"), "yyyy-MM-dd HH:mm").alias("d")).collect()
    assert [r.d for r in got] == ["2024-01-05 00:00", "2023-12-25 00:00", "2024-02-03 10:20"]
    tie = spark.createDataFrame([("05/01/2024",)], "v string")
    assert tie.select(F.month(D.parse_dates(tie, "v"))).first()[0] == 5


def test_status_precedence(spark):
    rows = spark.createDataFrame(
        [(None, None, None), (1.0, 0.9, 2.5), (1.0, 0.6, 1.0), (-1.0, -0.3, None), (1.0, 0.1, 0.0), (0.0, 0.0, None)],
        "delta double, pct double, z double",
    )
    got = [r[0] for r in rows.select(L.movement_status("delta", "pct", "z")).collect()]
    assert got == ["base", "outlier", "critical", "relevant", "up", "flat"]


def test_date_shapes(spark):
    texts = ["2024-01-05T10:00:00.75Z", "2024-01-05 10:00:00+03:00", "Jan 5, 2024", "5 January 2024", "05-sep-2024", "20240105", "20241399", "Janky 5, 2024", "31/12/24"]
    want = ["2024-01-05 10:00:00.75", "2024-01-05 10:00:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-09-05 00:00:00", "2024-01-05 00:00:00", None, None, "2024-12-31 00:00:00"]
    assert column(spark, texts, lambda c: D.parse_date(c, True).cast("string")) == want
