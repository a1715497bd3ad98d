"""Distinct counts and quantiles of any span of months from small states that are kept by month.

The exact operators (``stats.distinct_counts``, ``stats.quantiles``) read the rows again for each question. Here each month leaves a state of
fixed size; a span of months is a merge of states, so a question about any span reads no rows. Answers are estimates within
the stated bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count state, as a power of two, and the relative error that it keeps in all but 3 of 1,000 cases.
REGISTER_BITS = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (REGISTER_BITS / 2)
#: Size of a quantile state, and the error of its ranks (share of all rows) that it keeps in all but 1 of 100 cases.
QUANTILE_SIZE = 1600
RANK_ERROR = 0.005


def month_states(df: DataFrame, month: str, distinct: Sequence[str] = (), measured: Sequence[str] = ()) -> DataFrame:
    """One row a ``month``: a state of the distinct values of each column in ``distinct``, of the values of each in ``measured``.

    Missing values leave no trace; a column without any in a month has an empty state. NaN is read as missing.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(F.col(month).alias("month")).agg(
        *[F.hll_sketch_agg(F.col(c), REGISTER_BITS).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(number(c), QUANTILE_SIZE).alias(f"values_{c}") for c in measured],
    )


def merged(states: DataFrame, span: str) -> DataFrame:
    """States of the months of each ``span`` (a column of ``states``) merged to one."""
    merge = [
        (F.hll_union_agg(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c, QUANTILE_SIZE)).alias(c)
        for c in states.columns
        if c.startswith(("distinct_", "values_"))
    ]
    return states.groupBy(span).agg(*merge)


def distinct_estimate(column: str):
    """Estimated distinct values of a state: within ``DISTINCT_ERROR`` of the exact count."""
    return F.hll_sketch_estimate(f"distinct_{column}")


def quantile_estimate(column: str, share: float):
    """A value of the column whose rank is within ``RANK_ERROR`` of ``share``; null for an empty state."""
    state = F.col(f"values_{column}")
    return F.when(F.kll_sketch_get_n_double(state) > 0, F.kll_sketch_get_quantile_double(state, F.lit(float(share))))
