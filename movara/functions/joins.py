"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attached(left: DataFrame, values: DataFrame, key: Sequence[str], salt: Column, parts: int = 64) -> DataFrame:
    """``left`` with the columns of ``values`` (one row a key; null where there is none).

    A key's rows are dealt to ``parts`` by the hash of ``salt``, and its values are copied once to each part that has rows,
    so no key is one task's work however many rows it has.
    """
    key = list(key)
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(salt), F.lit(parts)))
    copies = dealt.select(*key, "__part").distinct().join(values, key)
    return dealt.join(copies, [*key, "__part"], "left").drop("__part")
