"""Operators that SQL can express against their SQL twins."""

import pytest

from movara.llm.queries import op1, op2, op10
from movara.llm.registry import ORACLES

from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, run", [("op1_url_filters", op1), ("op2_decontamination", op2), ("op10_exact_top_k", op10)])
def test_matches_sql(spark, name, run):
    assert differences(run(spark, SF), connect(SF), ORACLES[name]) == []
