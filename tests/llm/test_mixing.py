"""Mixing: targets by water filling, fits by brute force, whole tables."""

import random
from itertools import product

import numpy as np

from pyspark.sql import functions as F

from movara.llm import mixing
from movara.llm.mixing import fit, knapsack, mix_uploads

from tests.llm.plain import AWKWARD, frame, tokens


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_sources, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while rest > 1e-9 and open_sources:
        whole = sum(weight[s] for s in open_sources)
        for s in open_sources:
            target[s] += rest * weight[s] / whole
        rest = 0.0
        for s in sorted(open_sources, key=str):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_sources.discard(s)
    return target


def test_knapsack_is_nearest():
    rng = random.Random(8)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), 4))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 80)
        picked = knapsack(np.array(lengths), np.array(counts), budget)
        assert all(0 <= p <= c for p, c in zip(picked, counts))
        best = min(abs(sum(a * b for a, b in zip(lengths, p)) - budget) for p in product(*[range(c + 1) for c in counts]))
        assert abs(int(picked @ np.array(lengths)) - budget) == min(best, budget)


def test_fit_of_many_lengths():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    total = int(lengths @ counts)
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        picked = fit(lengths, counts, budget)
        assert ((picked >= 0) & (picked <= counts)).all()
        assert abs(int(picked @ lengths) - min(budget, total)) <= 1


def test_whole_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "B", "c", None, "é"]) if i % 3 else "hot", "w " * rng.randint(0, 60)) for i in range(1500)]
    rows += [(5000 + i, "hot", "same length text here") for i in range(800)]
    result = mix_uploads(frame(spark, rows), carry=("dataset_id", "file_name")).collect()
    length = {i: len(tokens(t)) for i, _, t in rows}
    sizes, taken = {}, {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + length[i]
    want = plain_targets(sizes)
    assert len(result) == len(rows)
    for r in result:
        assert r["size"] == length[r.dataset_id] and r.source_size == sizes[r.file_name] and 0 <= r.times <= 2
        assert abs(r.target - want[r.file_name]) < 1e-6 * max(1, r.target)
        taken[r.file_name] = taken.get(r.file_name, 0) + r["size"] * r.times
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mix_uploads(frame(spark, rows).repartition(7), carry=("dataset_id", "file_name")).collect()
    assert sorted(map(str, again)) == sorted(map(str, result))


def test_more_than_two_copies(spark):
    rows = [(i, "a", "w " * (1 + i % 7)) for i in range(60)] + [(100 + i, "b", "w w") for i in range(10)]
    result = mix_uploads(frame(spark, rows), share=6.0, most=4.5, carry=("dataset_id", "file_name")).collect()
    for source in ("a", "b"):
        taken = sum(r["size"] * r.times for r in result if r.file_name == source)
        target = next(r.target for r in result if r.file_name == source)
        assert target == 4.5 * sum(r["size"] for r in result if r.file_name == source) and abs(taken - target) <= 1
    assert {r.times for r in result} == {4, 5}


def test_awkward_rows(spark):
    result = mix_uploads(frame(spark)).collect()
    assert len(result) == len(AWKWARD)
    assert all(r.times == 0 for r in result if r["size"] == 0) and all(r.source_size is not None for r in result)
    assert mix_uploads(frame(spark, [])).count() == 0
    empty = mix_uploads(frame(spark, [(1, "a", ""), (2, None, None)])).collect()
    assert [(r.source_size, r.target, r.times) for r in empty] == [(0, 0.0, 0)] * 2


def test_many_sources_are_placed_in_parts(spark):
    names = [f"file {n * 7919 % 3000:05}" for n in range(3000)] + ["", "Z", "é", None]
    sizes = spark.createDataFrame([(n, 5) for n in names], "file_name string, source_size long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixing.placed(sizes).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.file_name: r.place for r in rows} == {n: i for i, n in enumerate(sorted(names[:-1]) + [None])}
    assert len({r.task for r in rows}) > 1
