"""Mixing files from several sources to target weights, by subset-sum budget fitting.

A source is an upload's ``file_name``. Uploads are counted by source and exact length in words. Each source
takes whole copies of everything as often as its target allows; the budget that remains is split over the lengths in
proportion, and what that leaves is fitted by a bounded-knapsack dynamic program over the lengths. Which
uploads of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.llm.common import saved

SEED = 20_240
#: Uploads of one source and length are dealt to so many groups by their hash; at most one of them is ranked.
GROUPS = 64
#: Words left to the dynamic program.
FITTED = 20_000


def length_in_words(content: Column) -> Column:
    return F.coalesce(F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with each source's ``place`` by code point, from 0, null last: its own in a range of names and those before."""
    ranges = sizes.repartitionByRange(F.col("file_name").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    held = saved(ranges)
    counts = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())
    before = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    offsets = sizes.sparkSession.createDataFrame(before, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("file_name").asc_nulls_last())) - 1
    return held.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "own", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (file_name, source_size) with each source's ``target`` in words.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. They share ``share`` of all words; a
    target stops at ``most`` times its source, and the excess is shared again by weight until none is above. One row
    a source is ranked; every round reads sums of them.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * F.lit(float(most))).alias("cap")
    ranked = saved(placed(sizes).select("file_name", "source_size", weight.alias("weight"), cap))
    goal = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        below = F.col("cap") <= F.col("weight") * level
        full, open_weight, n = ranked.agg(
            F.sum(F.when(below, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(below, 0.0).otherwise(F.col("weight"))),
            F.count_if(below),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (goal - full) / open_weight
    return ranked.select("file_name", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many uploads of each length come nearest to the budget together, at most their counts.

    Deterministic; the shares of the lengths stay in proportion but for the last ``FITTED`` words.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.random.default_rng(SEED).permutation(len(lengths))
    while rest > FITTED:
        before = rest
        for i in order:
            if rest > FITTED and lengths[i] <= rest and taken[i] < counts[i]:
                taken[i] += 1
                rest -= int(lengths[i])
        if rest == before:
            break
    for i in np.argsort(lengths, kind="stable"):  # give short ones back for the program to choose anew
        back = min(int(taken[i]), max(0, -(-(FITTED // 2 - rest) // int(lengths[i]))))
        taken[i] -= back
        rest += back * int(lengths[i])
    return taken + knapsack(lengths, counts - taken, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the counts whose total is nearest to the budget, the smaller of two as near."""
    room = 2 * budget
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    came = np.full(room + 1, -1, np.int64)
    pieces: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left, copies = min(int(counts[i]), room // int(lengths[i])), 1
        while left > 0 and not reached[budget]:
            step = min(copies, left)
            weight = step * int(lengths[i])
            new = np.flatnonzero(reached[: room + 1 - weight] & ~reached[weight:]) + weight
            reached[new] = True
            came[new] = len(pieces)
            pieces.append((int(i), step, weight))
            left, copies = left - step, copies * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    picked = np.zeros(len(lengths), np.int64)
    while at:
        i, step, weight = pieces[came[at]]
        picked[i] += step
        at -= weight
    return picked


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(rows["target"].iloc[0])
    whole = int(target // total)  # a target is at most ``most`` times its source
    extra = fit(lengths, counts, int(target - whole * total + 0.5))
    return rows[["file_name", "size"]].assign(whole=whole, extra=extra)


def mix_uploads(
    uploads: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    carry: tuple[str, ...] = ("dataset_id",),
    seed: int = SEED,
) -> DataFrame:
    """How often the mix takes each upload.

    ``uploads``: ``dataset_id``, ``file_name`` (the source), ``content`` and the ``carry`` columns. Returns the carried columns,
    ``size`` (words), ``source_size``, ``target`` (both the source's) and ``times``, at most ``most`` rounded up. A source's
    taken words come as near to its target as the fitted lengths allow; reruns agree.

    A missing or empty text has no words and is taken 0 times; a missing source is one of its own, the last;
    rows without id are told apart by their texts, and exactly repeated rows count each. Only counts by
    length reach one task, as many as a source has distinct lengths.
    """
    keyed = uploads.select(
        *[F.col(c) for c in carry],
        F.col("file_name").alias("__source"),
        length_in_words(F.col("content")).alias("size"),
        F.xxhash64(F.lit(seed), "dataset_id", "content").alias("__hash"),
    ).withColumn("__group", F.pmod("__hash", F.lit(GROUPS)))
    groups = saved(
        keyed.groupBy(F.col("__source").alias("file_name"), "size", F.col("__group").alias("group")).agg(F.count("*").alias("n"))
    )
    sizes = groups.groupBy("file_name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = saved(targets(sizes, weights, share, most))
    same = lambda a, b: a.file_name.eqNullSafe(b.file_name)
    lengths = groups.where("size > 0").groupBy("file_name", "size").agg(F.sum("n").alias("n"))
    named = wanted.select(F.col("file_name").alias("name"), "target")
    plan = (
        lengths.join(named, F.col("file_name").eqNullSafe(F.col("name")))
        .groupBy("file_name")
        .applyInPandas(_plan, "file_name string, size long, whole long, extra long")
    )
    # of a length's groups the first ones are taken whole, one in part, the others not
    by_length = plan.select(F.col("file_name").alias("name"), F.col("size").alias("words"), "whole", "extra")
    earlier = F.sum("n").over(
        Window.partitionBy("file_name", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    )
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.coalesce(earlier, F.lit(0))))
    drawn = groups.join(
        by_length, F.col("file_name").eqNullSafe(F.col("name")) & (F.col("size") == F.col("words")), "left"
    ).select(
        F.col("file_name").alias("name"), F.col("size").alias("words"), F.col("group").alias("part"), "whole", quota.alias("quota")
    )
    place = F.row_number().over(Window.partitionBy("__source", "size", "__group").orderBy("__hash"))
    times = F.coalesce(F.col("whole") + (place <= F.col("quota")).cast("long"), F.lit(0))
    rows = keyed.join(
        drawn,
        F.col("__source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("words")) & (F.col("__group") == F.col("part")),
        "left",
    ).select(*carry, "__source", "size", times.alias("times"))
    per_source = wanted.withColumnRenamed("file_name", "name")
    return rows.join(per_source, F.col("__source").eqNullSafe(F.col("name")), "left").select(
        *carry, "size", "source_size", "target", "times"
    )
