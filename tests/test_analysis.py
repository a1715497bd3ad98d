import pytest
from pyspark.sql import functions as F

from movara.operators import periods as P
from movara.operators import rank, roles, rootcause
from movara.operators import vocabulary as V
from movara.plans.causes import SPEC, mart
from movara.sources.mart import AnalysisSpec

SF = "/root/testdata/sf0.001"
INVENTORY = (
    "`Ano` int, `Month` string, `Produto` string, `Categoria` string, `FY GAAP` string, `Estoque Total (TON)` double, "
    "`Estoque Fabrica (TON)` double, `Volume Industrializado (TON)` double, `Custo (R$/TON)` double"
)


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [
        (2025, "JAN", "Cafe A", "Arabica", "FY25", 1000.0, 700.0, 120.0, 450.0),
        (2025, "JAN", "Cafe B", "Conilon", "FY25", 500.0, 300.0, 80.0, 440.0),
        (2025, "FEV", "Cafe A", "Arabica", "FY25", 900.0, 650.0, 130.0, 455.0),
        (2025, "FEV", "Cafe B", "Conilon", "FY25", 520.0, 310.0, 90.0, 442.0),
        (2025, "MAR", "Cafe A", "Arabica", "FY25", 100.0, 180.0, 460.0, 470.0),
        (2025, "MAR", "Cafe B", "Conilon", "FY25", 530.0, 320.0, 95.0, 445.0),
    ]
    return spark.createDataFrame(rows, INVENTORY)


@pytest.fixture(scope="module")
def prepared(inventory):
    from movara.functions.dates import month_period, year_month_date

    return inventory.select(
        month_period(year_month_date("Ano", "Month")).alias("period"),
        F.col("Estoque Total (TON)").alias("amount"),
        F.col("Produto").alias("produto"),
        F.col("Categoria").alias("categoria"),
        F.col("Custo (R$/TON)").alias("custo"),
        F.col("Volume Industrializado (TON)").alias("volume"),
    )


STOCK = AnalysisSpec(dimensions=("produto", "categoria"), supports={"custo": ("custo", "mean"), "volume": ("volume", "sum")})


def test_inventory_roles(inventory):
    typed = roles.profile(inventory)
    primary = {d: V.PRIMARY_METRICS[d] for d in V.ANALYSIS_DOMAINS}
    chosen = roles.chosen_domain(roles.domain_scores(typed, V.ANALYSIS_DOMAINS, primary), 2, 0.42, 0.07, 0.96).first()
    assert chosen.domain == "estoque_operacao" and chosen.confidence >= 0.7
    mapped = roles.metric_map(typed, V.PRIMARY_METRICS[chosen.domain], V.SUPPORT_METRICS[chosen.domain])
    assert {r.role: r.column for r in mapped.collect()} == {
        "primary_metric": "Estoque Total (TON)",
        "estoque_fabrica": "Estoque Fabrica (TON)",
        "volume_operacional": "Volume Industrializado (TON)",
        "custo": "Custo (R$/TON)",
    }
    assert roles.time_axis(inventory, typed).first().columns == "Ano + Month"


def test_fiscal_year_axis_and_month_only_refusal(spark):
    rows = [("FY24", "OUT", "A", 100.0), ("FY24", "DEZ", "B", 80.0), ("FY25", "FEV", "B", 190.0)]
    fiscal = spark.createDataFrame(rows, "`FY GAAP` string, Month string, Cliente string, Receita double")
    assert roles.time_axis(fiscal, roles.profile(fiscal)).first().columns == "FY GAAP + Month"
    months = spark.createDataFrame([("01-JAN", "Cafe", 100.0), ("01-FEV", "Cafe", 120.0)], "Month string, Produto string, Receita double")
    assert roles.time_axis(months, roles.profile(months)).first().columns is None


def test_metric_scores_refuse_identifiers(spark):
    rows = spark.createDataFrame([(1, 100.0, -5.0), (2, 200.0, -6.0)], "`Nº_NF` int, `Receita Total` double, `Desconto` double")
    scores = roles.metric_scores(roles.profile(rows), "vendas", V.DASHBOARD_METRIC_TERMS["vendas"], V.VALUE_TERMS)
    found = {r.column: r.score for r in scores.collect()}
    assert found["Nº_NF"] == -1000 and found["Receita Total"] > 0 > found["Desconto"]


def test_contributors_and_alerts(prepared):
    top = rootcause.contributors(prepared, STOCK)
    lead = rootcause.impact_ranking(top).where("impact_rank = 1").first()
    assert lead["name"] == "Arabica" or lead["name"] == "Cafe A"
    product = top.where("dimension = 'produto' AND position = 1").first()
    assert product["name"] == "Cafe A" and product.share_abs >= 0.9 and product.concentration == "high"
    assert product.delta == -800.0 and product.hist_mean == pytest.approx(666.6667)
    alerts = rootcause.concentration_alerts(top).collect()
    assert {(a.dimension, a.level) for a in alerts} == {("produto", "high"), ("categoria", "high")}
    series = P.period_metrics(prepared, STOCK)
    codes = {r.alert for r in rootcause.movement_alerts(series, STOCK, top, "custo", "volume").collect()}
    assert {"critical_movement", "large_drop", "dominant_contributor", "concentration_high"} <= codes
    assert "cost_up_volume_down" not in codes


def test_checkpointed_entities_give_the_same_result(prepared, tmp_path, monkeypatch):
    from movara.functions import sharing

    plain = sorted(map(tuple, rootcause.contributors(prepared, STOCK).collect()))
    monkeypatch.setattr(sharing, "checkpoint_dir", lambda spark: str(tmp_path))
    assert sorted(map(tuple, rootcause.contributors(prepared, STOCK).collect())) == plain
    assert any(tmp_path.iterdir())


def test_cost_up_volume_down(spark):
    rows = [("2025-01", 1000.0, "A", 450.0, 200.0), ("2025-02", 980.0, "A", 460.0, 180.0), ("2025-03", 400.0, "A", 490.0, 120.0)]
    df = spark.createDataFrame(rows, "period string, amount double, produto string, custo double, volume double")
    spec = AnalysisSpec(dimensions=("produto",), supports=STOCK.supports)
    series = P.period_metrics(df, spec)
    top = rootcause.contributors(df, spec)
    assert top.count() == 0  # one entity explains nothing
    codes = {r.alert for r in rootcause.movement_alerts(series, spec, top, "custo", "volume").collect()}
    assert {"large_drop", "cost_up_volume_down"} <= codes


def test_new_and_lost_entities(spark):
    rows = [("2024-01", 10.0, "a"), ("2024-01", 5.0, "b"), ("2024-02", 40.0, "c"), ("2024-02", 6.0, "b"), ("2024-02", 1.0, None)]
    df = spark.createDataFrame(rows, "period string, amount double, kind string")
    spec = AnalysisSpec(dimensions=("kind",), supports={})
    got = {r["name"]: (r.current_value, r.previous_value, r.pct) for r in rootcause.contributors(df, spec).collect()}
    assert got == {"a": (0.0, 10.0, -1.0), "b": (6.0, 5.0, 0.2), "c": (40.0, 0.0, None)}
    focus = P.focus_movement(P.movements(P.monthly_sum(df, "amount")))
    assert [r["name"] for r in rootcause.quick_evidence(df, spec, focus).collect()] == ["b"]


def test_series_windows(spark):
    rows = [("2024-01", 100.0), ("2024-02", 150.0), ("2024-04", 120.0), ("2024-05", 0.0), ("2024-06", 30.0)]
    moved = {r.period: r for r in P.movements(spark.createDataFrame(rows, "period string, value double")).collect()}
    assert moved["2024-04"].delta == -30.0 and moved["2024-04"].prev_period == "2024-02"
    assert moved["2024-02"].hist_mean is None and moved["2024-04"].hist_mean == 125.0
    assert moved["2024-04"].zscore is None and moved["2024-05"].zscore is not None
    assert moved["2024-06"].pct is None


def test_invariants(spark):
    rows = mart(spark, SF)
    top = rootcause.contributors(rows, SPEC)
    focus = P.focus_movement(P.movements(P.monthly_sum(rows, "amount"))).first()
    sums = top.where("dimension IN ('product_type', 'segment', 'region')").groupBy("dimension").agg(
        F.sum("delta").alias("d"), F.sum("share_abs").alias("s")
    )
    for r in sums.collect():
        assert r.d == pytest.approx(focus.delta, abs=0.01) and r.s == pytest.approx(1.0, abs=1e-3)
    focus_df = P.focus_movement(P.movements(P.monthly_sum(rows, "amount")))
    steps = rootcause.waterfall(top, SPEC, focus_df).orderBy("step").collect()
    assert steps[-1].running_total == pytest.approx(focus.value) and steps[0].running_total == pytest.approx(focus.prev_value)
    assert steps[-2].running_total == pytest.approx(focus.value, rel=0.011)


def test_sales_questions(spark):
    rows = [("2024-01-05", "Cafe", 1000.0), ("2024-01-06", "Cha", 1500.0), ("2024-02-01", "Suco", 1600.0), (None, None, None)]
    df = spark.createDataFrame(rows, "Data string, Produto string, Valor double")
    assert rank.distinct_values(df, "Produto").first().distinct_values == 3
    assert rank.metric_totals(df, "Valor").first().total == 4100.0
    assert [r["name"] for r in rank.rank_by_sum(df, "Produto", "Valor", ascending=True).collect()] == ["Cafe", "Cha", "Suco"]


def test_package_joins_the_lookups_once(spark, monkeypatch):
    """All tables of the package read one written mart."""
    from movara.plans import causes

    asked, real = [], causes.sales_mart
    monkeypatch.setattr(causes, "sales_mart", lambda s, d, *columns: asked.append(columns) or real(s, d, *columns))
    assert causes.export_package(spark, "/root/testdata/sf0.001").count() == 5
    assert sum("brand" in columns for columns in asked) == 1
