"""A cross-section of registered queries against their SQL twins on the smallest tables.

``python tests/check.py`` compares all of them.
"""

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
CROSS_SECTION = """monthly_comparison monthly_drivers comparative_cards rank_top8_share facet_counts duplicate_rows
numeric_summary iqr_outliers filter_report parse_number parse_period header_gate column_types impact_ranking
export_monthly dashboard_filtered audit_findings""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_matches_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == []


def test_contract(spark, tmp_path):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
    from movara.operators.export import write_tables

    write_tables({"monthly": contract.queries()["export_monthly"](spark, SF)}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "monthly")).count() == 18
