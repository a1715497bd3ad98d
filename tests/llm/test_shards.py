"""Shards: exact counts, even bytes, numbering, copies kept together."""

import random

from pyspark.sql import functions as F

from movara.llm import shards as module
from movara.llm.shards import OVERHEAD, shard_uploads, write_shards

from tests.llm.plain import frame


def shared_out(spark, rows, shards, **more):
    return shard_uploads(frame(spark, rows), shards, carry=("dataset_id", "content"), **more).collect()


def check(rows, result, shards):
    assert sorted((str(r.dataset_id), r.content) for r in result if r.content) == sorted((str(i), t) for i, _, t in rows if t)
    assert all(r["size"] == len((r.content or "").encode()) + OVERHEAD for r in result)
    slots, sizes = {}, [0] * shards
    for r in result:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_even_bytes(spark):
    rng = random.Random(5)
    rows = [(i, "f", "é" * rng.randint(0, 400) + str(i)) for i in range(3000)]
    sizes = check(rows, shared_out(spark, rows, 10), 10)
    assert max(sizes) - min(sizes) <= 0.002 * sum(sizes) / 10 + 900


def test_a_hot_text_is_cut_only_at_edges(spark):
    rows = [(i, "f", "the same report" if i % 2 else f"report {i}") for i in range(2000)]
    result = shared_out(spark, rows, 8)
    sizes = check(rows, result, 8)
    assert max(sizes) - min(sizes) <= 200
    holding = sorted({r.shard for r in result if r.content == "the same report"})
    assert holding == list(range(holding[0], holding[-1] + 1)) and 4 <= len(holding) <= 6


def test_small_copies_stay_together(spark):
    rows = [(i, "f", f"text {i // 3} " * 20) for i in range(900)]
    result = shared_out(spark, rows, 6)
    check(rows, result, 6)
    split = {}
    for r in result:
        split.setdefault(r.content, set()).add(r.shard)
    assert sum(len(s) > 1 for s in split.values()) <= 5


def test_a_third_of_all_rows_is_one_row(spark):
    rows = [(7, "f", "the same upload " * 9) for _ in range(1000)] + [(i, "f", f"report {i} " * 15) for i in range(2000)]
    result = shared_out(spark, rows, 10)
    sizes = check(rows, result, 10)
    assert max(sizes) - min(sizes) <= 700
    holding = sorted({r.shard for r in result if r.dataset_id == 7 and r.content.startswith("the same")})
    assert holding == list(range(holding[0], holding[-1] + 1)) and 3 <= len(holding) <= 5


def test_only_repeats(spark):
    for row in ((None, "f", None), (1, "f", "one upload")):
        sizes = check([row] * 103, shared_out(spark, [row] * 103, 10), 10)
        assert max(sizes) - min(sizes) <= max(sizes) / 10


def test_a_clashing_and_a_map_column_are_carried(spark):
    some = frame(spark, [(1, "f", "x"), (1, "f", "x"), (2, "f", None)])
    some = some.withColumn("leaf", F.lit("mine")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    record = some.select("dataset_id", "content", F.struct("leaf", "m").alias("record"))
    out = shard_uploads(record, 2, carry=("record",)).collect()
    assert len(out) == 3 and all(r.record.leaf == "mine" and r.record.m == {"a": 1} for r in out)


def test_awkward_rows(spark):
    rows = [(1, "f", None), (1, "f", ""), (None, "f", None), (2, "f", "x" * 300_000), (2, "f", "x" * 300_000), (3, None, "y")]
    check(rows, shared_out(spark, rows, 4), 4)
    assert shared_out(spark, [], 4) == []
    assert {r.shard for r in shared_out(spark, [(1, "f", "z")], 40)} <= set(range(40))


def test_same_result_whatever_the_partitions(spark):
    rows = [(i, "f", f"text {i}") for i in range(500)]
    one = shard_uploads(frame(spark, rows), 7).collect()
    other = shard_uploads(frame(spark, rows).repartition(11), 7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_prefixes_follow_key_order(spark):
    keys = [-(2**63), -1, 0, 1, 2**63 - 1, 12345678901234567, -98765432109876543]
    for bits in module.PREFIXES:
        got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", module.prefix(F.col("key"), bits).alias("p"))
        ordered = sorted(tuple(r) for r in got.collect())
        assert [p for _, p in ordered] == sorted(p for _, p in ordered)


def test_written_folders(spark, tmp_path):
    rows = [(i, "f", f"text {i}") for i in range(50)]
    write_shards(shard_uploads(frame(spark, rows), 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3
