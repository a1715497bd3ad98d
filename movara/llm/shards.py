"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Uploads are ordered by a 64-bit key: 36 bits of the text's hash, so that equal texts are neighbours, then
28 bits of the id's hash, so that a large group of copies can still be cut. Exact bytes and rows below candidate
boundaries (key prefixes) are counted across all partitions; only prefixes that hold a boundary beyond the tolerance, or too
many rows for one task, are counted again with a longer prefix. Rows of one whole key are repeats of one upload: they are cut by
their number. Once every splitter is settled the uploads are exchanged once and numbered.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from movara.llm.common import saved

#: Bytes that each upload counts besides its text.
OVERHEAD = 16
#: Prefix lengths of the rounds; the text's hash has the first 36 bits.
PREFIXES = (12, 20, 28, 36, 44, 52, 60, 64)
TEXT_BITS = 36
#: No numbered block may hold more than this share of all rows while its prefix can grow.
BLOCK_SHARE = 1 / 256


def upload_size(content: Column) -> Column:
    """UTF-8 bytes of the text plus the overhead; a missing text has none."""
    return F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + OVERHEAD


def shard_key(content: Column, dataset_id: Column) -> Column:
    low = (1 << (64 - TEXT_BITS)) - 1
    text = F.xxhash64(F.coalesce(content, F.lit(""))).bitwiseAND(F.lit(~low))
    return text.bitwiseOR(F.xxhash64(dataset_id).bitwiseAND(F.lit(low)))


def prefix(key: Column, bits: int) -> Column:
    """The key's first bits, in the key's order."""
    return F.shiftright(key, 64 - bits)


@dataclass
class Leaf:
    """All keys with one prefix: what they hold, and later where they go."""

    bits: int
    prefix: int
    size: int
    rows: int
    hot: bool = False
    #: (number of the leaf's first row there, shard, rows of earlier leaves in the shard), in order
    cuts: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def low(self) -> int:
        return self.prefix << (64 - self.bits)


def _small(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few rows that the driver holds, as a frame of literals."""
    literal = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.range(1).select(F.inline(literal))


def _counted(keys: DataFrame, bits: int, within: list[Leaf] | None) -> list[Leaf]:
    """Exact bytes and rows of every prefix, of the keys inside the given leaves."""
    if within:
        parents = _small(keys.sparkSession, [{"parent": leaf.prefix} for leaf in within], "parent: bigint")
        keys = keys.join(F.broadcast(parents), prefix(F.col("key"), within[0].bits) == F.col("parent"), "left_semi")
    counts = keys.groupBy(prefix(F.col("key"), bits).alias("prefix")).agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")
    )
    return [Leaf(bits, r["prefix"], r["size"], r["rows"]) for r in counts.collect()]


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[Leaf]:
    """Leaves in key order with their cuts.

    ``keys``: ``key``, ``size``. The driver holds at most 4,096 leaves of the first round and 256 for each leaf
    that was counted again; a round counts again at most ``shards`` - 1 leaves for their boundary and
    1 / ``BLOCK_SHARE`` for their rows.
    """
    leaves = _counted(keys, PREFIXES[0], None)
    total, count = sum(leaf.size for leaf in leaves), sum(leaf.rows for leaf in leaves)
    block = max(1, count * BLOCK_SHARE)
    for bits, longer in zip(PREFIXES, PREFIXES[1:]):
        leaves.sort(key=lambda leaf: leaf.low)
        again, below, target = [], 0, 1
        for leaf in leaves:
            end, missed = below + leaf.size, False
            while target < shards and total * target / shards <= end:
                goal = total * target / shards
                missed |= min(goal - below, end - goal) > tolerance * total / shards
                target += 1
            if leaf.bits == bits and leaf.rows > 1 and (missed or leaf.rows > block):
                again.append(leaf)
            below = end
        if again:
            gone = {id(leaf) for leaf in again}
            leaves = [leaf for leaf in leaves if id(leaf) not in gone] + _counted(keys, longer, again)
    leaves.sort(key=lambda leaf: leaf.low)
    below, filled = 0, [0] * shards
    for leaf in leaves:
        leaf.hot = leaf.bits == PREFIXES[-1] and leaf.rows > block
        # a leaf goes where its middle lies; of a whole key, where each row's middle lies
        pieces = leaf.rows if leaf.bits == PREFIXES[-1] else 1
        at = 0
        while at < pieces:
            middle = below * pieces + leaf.size * at + leaf.size / 2
            shard = min(shards - 1, int(middle * shards / (total * pieces)))
            end = pieces
            if shard < shards - 1 and leaf.size:  # the first row whose middle lies beyond the shard
                beyond = total * (shard + 1) / shards - below
                end = min(pieces, max(at + 1, int(-(-(beyond * pieces / leaf.size - 0.5) // 1))))
            leaf.cuts.append((at, shard, filled[shard]))
            filled[shard] += end - at if pieces > 1 else leaf.rows
            at = end
        below += leaf.size
    return leaves


def placed(rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """Each row with its leaf (``low``, ``hot``, ``cuts``); the leaves are few by construction."""
    cut = ("first", "shard", "before")
    fields = "prefix: bigint, low: bigint, hot: boolean, cuts: array<struct<first: bigint, shard: int, before: bigint>>"
    found = []
    for bits in sorted({leaf.bits for leaf in leaves}):
        few = [
            {"prefix": leaf.prefix, "low": leaf.low, "hot": leaf.hot, "cuts": [dict(zip(cut, c)) for c in leaf.cuts]}
            for leaf in leaves
            if leaf.bits == bits
        ]
        own = _small(rows.sparkSession, few, fields).select("prefix", F.struct("low", "hot", "cuts").alias(f"leaf{bits}"))
        rows = rows.join(F.broadcast(own), prefix(F.col("key"), bits) == F.col("prefix"), "left").drop("prefix")
        found.append(f"leaf{bits}")
    return rows.withColumn("leaf", F.coalesce(*found)).drop(*found)


def _numbered_repeats(rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """Rows of hot leaves with their ``number``: dealt at random, which is written down, then numbered hand by hand."""
    count = sum(leaf.rows for leaf in leaves)
    hands = max(2, int(max(leaf.rows for leaf in leaves) / max(1, count * BLOCK_SHARE)) + 1)
    dealt = saved(rows.where("leaf.hot").withColumn("hand", F.floor(F.rand(7) * hands)))
    counts = dealt.groupBy(F.col("leaf.low").alias("low"), "hand").agg(F.count("*").alias("rows")).collect()
    starts, seen = [], {}
    for r in sorted(counts):
        starts.append({"low": r["low"], "dealt": r["hand"], "start": seen.get(r["low"], 0)})
        seen[r["low"]] = starts[-1]["start"] + r["rows"]
    start = _small(rows.sparkSession, starts, "low: bigint, dealt: bigint, start: bigint")
    number = F.row_number().over(Window.partitionBy("leaf.low", "hand").orderBy("tie"))
    numbered = dealt.withColumn("number", number - 1)
    same = (F.col("leaf.low") == F.col("low")) & (F.col("hand") == F.col("dealt"))
    return numbered.join(F.broadcast(start), same).withColumn("number", F.col("number") + F.col("start")).drop(
        "hand", "low", "dealt", "start"
    )


def shard_uploads(
    uploads: DataFrame, shards: int = 40, tolerance: float = 0.001, carry: tuple[str, ...] = ("dataset_id",)
) -> DataFrame:
    """Uploads in ``shards`` shards of near equal bytes, each numbered without gaps.

    ``uploads``: ``dataset_id``, ``content`` and the ``carry`` columns. Returns the carried columns, ``size``,
    ``shard`` and ``slot`` (from 0 in each shard, in key order). A shard's edge misses its exact place by at
    most ``tolerance`` of a shard or half of one upload; equal texts stay together but where an edge cuts
    their group.

    A missing text counts only its overhead and sorts as an empty one; rows without id share a hash;
    exactly repeated rows (same id, same text) share a key and are cut by their number: any number of them is
    dealt over tasks and shards. Of such rows that differ in carried columns the order goes by their hash. An empty table
    stays empty; with fewer uploads than shards some shards have no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    hashed = [c for c in carry if not any(t in uploads.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    keyed = uploads.select(
        *[F.col(c) for c in carry],
        upload_size(F.col("content")).alias("size"),
        shard_key(F.col("content"), F.col("dataset_id")).alias("key"),
        F.xxhash64("content", "dataset_id", *hashed).alias("tie"),
    )
    leaves = splitters(saved(keyed.select("key", "size")), shards, tolerance)
    if not leaves:
        return keyed.select(*carry, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    rows = placed(keyed, leaves)
    number = F.row_number().over(Window.partitionBy("leaf.low").orderBy("key", "tie"))
    numbered = rows.where("not leaf.hot").withColumn("number", (number - 1).cast("long"))
    if any(leaf.hot for leaf in leaves):
        numbered = numbered.unionByName(_numbered_repeats(rows, leaves))
    cut = F.element_at(F.filter("leaf.cuts", lambda c: c["first"] <= F.col("number")), -1)
    return numbered.withColumn("cut", cut).select(
        *carry, "size", "cut.shard", (F.col("cut.before") + F.col("number") - F.col("cut.first")).alias("slot")
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder of Parquet files a shard."""
    sharded.write.partitionBy("shard").parquet(folder)
