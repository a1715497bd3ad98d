"""Near copies of uploads: 64-bit SimHash fingerprints linked by Hamming distance.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word shingles. Fingerprints
within ``radius`` bits of each other agree on at least ``BLOCKS - radius`` of the bit blocks, so
tables keyed by every choice of that many blocks bring all of them together. Inside a table's bucket the
comparison is bit-sliced: bit planes are stored vertically (one machine word holds one bit of 64
fingerprints), distances of 64 pairs at once are kept in carry-save counters, and a block is abandoned as
soon as all its counters exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.llm.common import map_content, saved
from movara.llm.components import components

SEED = 42
#: Fingerprint bits are cut into this many blocks for the candidate tables.
BLOCKS = 5
#: A bucket of more fingerprints is cut into parts of about this size, and all pairs of parts are compared.
PART = 2048
#: Small buckets are compared together until a block holds so many fingerprints.
LANES = 512
#: Shingles hashed at once.
CHUNK = 65_536

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(content: bytes | None, shingle: int = 3) -> int:
    """Majority bits over the hashes of all shingles, repeats included; zero for a text without words."""
    tokens = content.lower().split() if content else []
    if not tokens:
        return 0
    size = min(shingle, len(tokens))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(tokens[k:] for k in range(size)))), repeat(SEED))
    total, ones = len(tokens) - size + 1, np.zeros(64, np.int64)
    while (part := np.fromiter(islice(hashes, CHUNK), np.uint64)).size:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): plane p holds bit p of every fingerprint, 64 fingerprints a word."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_lanes(planes: np.ndarray, asked: np.ndarray, over: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked fingerprint with any: its row and the lanes within ``radius``.

    ``over`` (rows, words) marks lanes that are settled already; it is changed.
    """
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius  # so that the counter overflows at radius + 1
    rows = np.arange(len(asked))
    wanted = np.unpackbits(asked.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counters = [np.full(over.shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    for p in range(64):
        carry = planes[p] ^ np.where(wanted[:, p, None] == 1, FULL, np.uint64(0))
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if p % 8 == 7 and p < 63:
            open_rows = (over != FULL).any(axis=1)
            if not open_rows.any():
                return
            if open_rows.mean() < 0.7:
                rows, wanted, over = rows[open_rows], wanted[open_rows], over[open_rows]
                counters = [c[open_rows] for c in counters]
    for row, settled in zip(rows, over, strict=True):
        if (settled != FULL).any():
            yield int(row), np.flatnonzero(np.unpackbits(settled.view(np.uint8), bitorder="little") == 0)


def forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """Links that connect the fingerprints as all pairs within ``radius`` would, fewer than fingerprints."""
    n = len(prints)
    planes, label = bit_planes(prints), np.arange(n)
    lanes = planes.shape[1] * 64
    for at in range(0, n, 256):
        asked = np.arange(at, min(at + 256, n))
        passed = (np.arange(lanes) <= asked[:, None]) | (np.arange(lanes) >= n)
        over = np.packbits(passed, axis=1, bitorder="little").view(np.uint64)
        for row, near in close_lanes(planes, prints[asked], over, radius):
            own = np.unique(np.append(label[near], label[at + row]))
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    linked = np.flatnonzero(label != np.arange(n))
    return np.stack([prints[linked], prints[label[linked]]], axis=1)


def _bucket_links(radius: int):
    """Over rows sorted by bucket: links of whole buckets, small ones compared together."""

    def links(prints: np.ndarray) -> pa.RecordBatch:
        found = forest(prints, radius).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, buckets = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        for batch in batches:
            prints = np.concatenate([prints, batch.column(0).to_numpy().view(np.uint64)])
            keys = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], axis=1)
            buckets = np.concatenate([buckets, keys])
            ends = np.flatnonzero((buckets[1:] != buckets[:-1]).any(axis=1)) + 1
            done = 0
            for end in ends:
                if end - done >= LANES:
                    yield links(prints[done:end])
                    done = end
            prints, buckets = prints[done:], buckets[done:]
        if len(prints) > 1:
            yield links(prints)

    return run


def candidate_keys(print_column, radius: int):
    """(table, key) of each choice of blocks that close fingerprints must share."""
    if not 0 < radius < BLOCKS:
        raise ValueError(f"radius must be between 1 and {BLOCKS - 1}")
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [sum(pick) for pick in combinations(masks, BLOCKS - radius)]
    return F.array(
        *[
            F.struct(F.lit(t).cast("long").alias("table"), print_column.bitwiseAND(F.lit(signed(m))).alias("key"))
            for t, m in enumerate(chosen)
        ]
    )


def close_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect distinct ``fingerprint`` values as all pairs within ``radius`` bits would."""
    keyed = prints.select("fingerprint", F.explode(candidate_keys(F.col("fingerprint"), radius)).alias("k")).select(
        "fingerprint", "k.table", "k.key"
    )
    large = keyed.groupBy("table", "key").count().where(F.col("count") > PART)
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / PART).cast("long")
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")),
    )
    dealt = (
        keyed.join(large, ["table", "key"], "left")
        .withColumn("parts", parts)
        .withColumn("part", part)
        .select("fingerprint", "table", "key", F.explode(pairs).alias("pair"))
        .select("fingerprint", "table", "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    )
    sorted_buckets = dealt.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    return sorted_buckets.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def near_copies(uploads: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Every upload with its fingerprint and its group of near copies.

    ``uploads``: ``dataset_id``, ``content``. Returns ``dataset_id``, ``content_key`` (XXH64 of the text),
    ``fingerprint`` (signed 64 bits), ``group`` (the smallest fingerprint reachable over links of at
    most ``radius`` differing bits) and ``component_id``, the group's smallest dataset_id.

    A missing or empty text has no words and the fingerprint zero, linked like any other; repeated rows
    keep their rows; an upload without id is grouped but never names its group unless no member has
    an id (then null). Exact copies collapse to one fingerprint before any comparison.
    """
    keyed = uploads.select(
        "dataset_id", F.xxhash64("content").alias("content_key"), "content"
    )
    prints = saved(
        map_content(
            keyed,
            ("dataset_id", "content_key"),
            "fingerprint long",
            lambda: lambda contents: {"fingerprint": [fingerprint(c, shingle) for c in contents]},
        )
    )
    firsts = prints.groupBy("fingerprint").agg(F.min("dataset_id").alias("first_id"))
    roots = components(close_links(firsts, radius))
    grouped = firsts.join(roots, firsts.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first_id"
    )
    names = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = saved(grouped.join(names, "root").select("fingerprint", F.col("root").alias("group"), "component_id"))
    return attached(prints, named, ["fingerprint"], F.struct("dataset_id", "content_key")).select("dataset_id", "content_key", "fingerprint", "group", "component_id")
