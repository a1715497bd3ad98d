"""Near copies of uploads: SimHash groups and MinHash buckets, settled by the exact Jaccard similarity of word shingles.

Candidates are the groups that ``simhash.near_copies`` links by fingerprint, and for copies whose fingerprints differ in more
bits, texts that agree on all rows of a MinHash band. With ``BANDS`` bands of ``ROWS`` rows a pair at similarity s meets with
probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8. Groups and buckets are joined to clusters, and inside each cluster all
pairs are compared in full, so no link depends on the estimates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.functions.sharing import written
from movara.llm.common import map_content, saved
from movara.llm.components import components
from movara.llm.simhash import SEED, near_copies

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
NEAR = (4, 5)
BANDS, ROWS = 40, 7
#: A cluster of more texts is cut into parts of about this size, and all pairs of parts are compared.
PART = 512
#: Shingles permuted at once.
CHUNK = 2048

_draw = np.random.default_rng(SEED)
STEPS = _draw.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
SLOPES = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
SHIFTS = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64)


def mixed_bits(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(content: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of all shingles; a text of fewer words is one shingle, one without words has none."""
    tokens = content.lower().split() if content else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(SEED)), np.uint64, len(tokens))
    size = min(SHINGLE, len(tokens))
    total = np.full(len(tokens) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed_bits(total + hashes[k : k + len(total)] * STEPS[k])
    return np.unique(total)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band: the hash of its rows' smallest permuted shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        least = np.minimum(least, (SLOPES[:, None] * shingles[None, at : at + CHUNK] + SHIFTS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed_bits(keys * STEPS[0] + row)
    return keys.view(np.int64)


def near_links(nodes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links that connect the nodes as all pairs of near sets would, fewer than nodes."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, held = np.arange(len(sets)), np.zeros(len(names), np.int64)
    for i in range(1, len(sets)):
        held[codes[starts[i] : starts[i + 1]]] = 1
        both = np.add.reduceat(held[codes[: starts[i]]], starts[:i])
        held[codes[starts[i] : starts[i + 1]]] = 0
        near = np.flatnonzero(both * NEAR[1] >= NEAR[0] * (sizes[:i] + sizes[i] - both))
        own = np.unique(np.append(label[near], label[i]))
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    linked = np.flatnonzero(label != np.arange(len(sets)))
    return np.stack([nodes[linked], nodes[label[linked]]], axis=1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (second column) compressed one by one, as they are shuffled twice."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        packed = [None if (text := value.as_buffer()) is None else codec.compress(text, asbytes=True) for value in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["content_key", "packed"])


def unpacked(packed: pa.Buffer | None) -> bytes | None:
    return None if packed is None else pa.input_stream(packed, compression="zstd").read()


def _cluster_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (node, cluster, i, j, packed text) sorted by cluster and parts: links of each."""

    def links() -> pa.RecordBatch:
        found = near_links(np.array(nodes, np.int64), sets)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    nodes, sets, before = [], [], None
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(1, 4)))
        for node, key, packed in zip(batch.column(0).to_pylist(), keys, batch.column(4)):
            if key != before and len(nodes) > 1:
                yield links()
            if key != before:
                nodes, sets, before = [], [], key
            nodes.append(node)
            sets.append(shingle_set(unpacked(packed.as_buffer())))
    if len(nodes) > 1:
        yield links()


def _run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, node) sorted by both: links (a, b) from every node of a key to its first one here.

    The first nodes of the first and the last key follow with their ``key``, as these may go on in other tasks.
    """

    def made(a, b, key=None) -> pa.RecordBatch:
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), keys], ["a", "b", "key"])

    begun = open_run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.append(True, keys[1:] != keys[:-1])
        at = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
        low = nodes[at]
        if open_run and open_run[0] == keys[0]:
            low[at == 0] = open_run[1]
        open_run = int(keys[-1]), int(low[-1])
        begun = begun or (int(keys[0]), int(low[0]))
        linked = nodes != low
        yield made(nodes[linked], low[linked])
    if begun:
        ends = sorted({begun, open_run})
        yield made([n for _, n in ends], [n for _, n in ends], [k for k, _ in ends])


def candidate_links(keyed: DataFrame) -> DataFrame:
    """``keyed`` (node, key) to links (a, b) that connect all nodes of a key; a link may come more than once.

    The rows are ordered over all tasks by one shuffle, so a key that many nodes share is cut between tasks, and the pieces'
    first nodes are linked.
    """
    ordered = keyed.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = written(ordered.mapInArrow(_run_links, "a long, b long, key long"), "bucket-links")
    ends = found.where("key IS NOT NULL").select("key", "a")
    across = ends.join(ends.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
    return found.where("key IS NULL").select("a", "b").unionByName(across).where("a <> b")


def close_texts(uploads: DataFrame, firsts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose texts are near.

    ``firsts`` has the ``content_key`` of a text of each node, ``clusters`` the cluster of each node that has one.
    A text is shuffled twice, packed: to meet its cluster, copies once, and to meet the texts of its parts.
    """
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")),
    )
    asked = clusters.join(sizes, "cluster").join(firsts, "node").withColumn("part", part)
    keyed = uploads.select(F.xxhash64("content").alias("content_key"), F.col("content").cast("binary").alias("content"))
    texts = keyed.mapInArrow(_packed, "content_key long, packed binary").groupBy("content_key").agg(F.first("packed").alias("packed"))
    dealt = texts.join(asked, "content_key").select("node", "cluster", F.explode(pairs).alias("pair"), "packed").select(
        "node", "cluster", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "packed"
    )
    sorted_parts = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return sorted_parts.mapInArrow(_cluster_links, "a long, b long").distinct()


def _upload(dataset_id: str, content_key) -> Column:
    """What tells uploads apart, in their order: those without id last."""
    return F.struct(F.col(dataset_id).isNull().alias("unnamed"), dataset_id, content_key)


def linked_texts(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prints`` (``dataset_id``, ``content_key``, ``node``) and one row a node with its ``first`` upload and its ``group``.

    Texts with the same shingles, and all texts without words, are one node; nodes are linked by a similarity of at least 0.8.
    """

    def start():
        def step(contents: list) -> dict[str, list]:
            sets = [shingle_set(c) for c in contents]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets]
            return {
                "node": np.array(nodes, np.uint64).view(np.int64).tolist(),
                "bands": [band_keys(s).tolist() if len(s) else [] for s in sets],
            }

        return step

    keyed = uploads.select("dataset_id", F.xxhash64("content").alias("content_key"), "content")
    prints = saved(map_content(keyed, ("dataset_id", "content_key"), "node long, bands array<long>", start))
    # a key names its band, too
    bands = prints.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    # the fingerprint groups are one more band; texts without words are one node already
    nodes = prints.where("node <> 0").select("node", "content_key").distinct()
    copies = near_copies(uploads).select("content_key", "group").distinct()
    groups = nodes.join(copies, "content_key").select("node", F.xxhash64(F.lit(BANDS), "group").alias("key")).distinct()
    found = components(candidate_links(bands.unionByName(groups)))
    clusters = found.select("node", F.col("root").alias("cluster")).unionByName(
        found.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    )
    firsts = prints.groupBy("node").agg(F.min(_upload("dataset_id", "content_key")).alias("first"))
    roots = components(close_texts(uploads, firsts.select("node", "first.content_key"), clusters))
    grouped = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("group"))
    return prints.drop("bands"), grouped


def near_texts(uploads: DataFrame) -> DataFrame:
    """Every upload (``dataset_id``, ``content_key``) with its ``group`` of texts linked by a similarity of at least 0.8.

    Missing and empty texts are one group; rows without id are grouped like any other; repeated rows keep their rows; an
    empty table has no groups.
    """
    prints, grouped = linked_texts(uploads)
    return attached(prints, grouped.select("node", "group"), ["node"], F.struct("dataset_id", "content_key")).select("dataset_id", "content_key", "group")


def one_per_text(uploads: DataFrame) -> DataFrame:
    """The ``record`` of one upload of each group of near texts: of the smallest id (rows without id last), then content key.

    The choice is made among one upload a distinct text, so no group of copies is joined or gathered. Of rows with the same id and text the
    record of the smallest hash stays, the same on every run.
    """
    _, grouped = linked_texts(uploads)
    kept = grouped.groupBy("group").agg(F.min("first").alias("first")).select("first")
    texts = uploads.select(_upload("dataset_id", F.xxhash64("content").alias("content_key")).alias("first"), "record")
    once = texts.groupBy("first").agg(F.min_by("record", F.xxhash64("record")).alias("record"))
    return once.join(kept, "first", "left_semi").select("record")
