"""The trie of conversation starts: which conversations share their first turns, and what sharing saves.

Every start of a conversation has a digest of its turns. A count-min sketch over all digests is an upper bound of how many
conversations share a start: where it says one, the start is proven to be of one conversation only, and so is all that
follows, so the whole tail is settled where it stands. Only starts that may be shared are shuffled and grouped exactly.

The digest is a polynomial over the turns' hashes, so a conversation of any length may be cut between tasks: each task
sums up the turns it has, the sums (one row a task) are carried on, and each task then goes on from the right state.
The library itself keeps no conversations (its model of a question is one text and one answer), so this operator is general.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.functions.sharing import written
from movara.llm.common import saved

#: A Mersenne prime and the step of the polynomial digest.
PRIME = (1 << 127) - 1
STEP = 0x5DEECE66D1234567F1EA5EED0DDBA115 % PRIME
#: Rows of the sketch and its counters a row, a power of two: 4 x 2 MB as bits. More conversations than that only prove less.
SKETCH_ROWS, SKETCH_BITS = 4, 24
#: Sketch bytes merged as one row.
PIECE = 1 << 16
#: Characters of joined ids kept as one row.
JOINED = 1 << 20

VISIT = "node binary, parent binary, conversation_id long, depth int, chars long, reach long, ends boolean"


def turn_keys(turns: DataFrame, *carry: str) -> DataFrame:
    """``turns`` (``role``, ``content``, the carried columns) as ``key`` (MD5 of role and text) and ``chars`` of the text.

    A missing role or text is an empty one. Whole texts are hashed once, here; later steps move only keys.
    """
    role, content = F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, content)).cast("binary")))
    return turns.select(*carry, key.alias("key"), F.char_length(content).cast("long").alias("chars"))


@dataclass
class State:
    """Where a conversation stands: its turns so far, their digest and their characters."""

    conversation: int | None = None
    depth: int = 0
    digest: int = 1
    reach: int = 0

    def after(self, depth: int, digest: int, reach: int) -> State:
        moved = (self.digest * pow(STEP, depth, PRIME) + digest) % PRIME
        return State(self.conversation, self.depth + depth, moved, self.reach + reach)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has of its first and its last conversation."""
    part, first, run = None, None, None
    for batch in batches:
        for part, conversation, key, chars in _rows(batch):
            if run is None or run[0] != conversation:
                first = first or run
                run = [conversation, 0, 0, 0]
            if key is not None:
                run[1:] = run[1] + 1, (run[2] * STEP + int.from_bytes(key) + 1) % PRIME, run[3] + chars
    if run is not None:
        ends = [first or run, run]
        columns = [[part, part], [0, 1], *[[e[k] for e in ends] for k in (0, 1)], [e[2].to_bytes(16) for e in ends], [e[3] for e in ends]]
        names = ["part", "last", "conversation_id", "depth", "digest", "reach"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def carried(sums: list) -> dict[int, tuple[State, bool]]:
    """For each task the state it starts from, and whether its last conversation has turns in later tasks."""
    tasks = [(a, b) for a, b in zip(sums[::2], sums[1::2], strict=True)]
    states, state = {}, State()
    for first, last in tasks:
        begun = state if state.conversation == first.conversation_id else State()
        states[first.part] = begun
        from_start = State(last.conversation_id)
        if first.conversation_id == last.conversation_id:
            from_start = State(last.conversation_id, begun.depth, begun.digest, begun.reach)
        state = from_start.after(last.depth, int.from_bytes(last.digest), last.reach)
    more, following, later = {}, None, False
    for first, last in reversed(tasks):
        goes_on = following == last.conversation_id and later
        more[first.part] = goes_on
        later = first.depth > 0 or (goes_on and first.conversation_id == last.conversation_id)
        following = first.conversation_id
    return {part: (begun, more[part]) for part, begun in states.items()}


def _walk(states: dict[int, tuple[State, bool]]):
    """Every start of every conversation, in order; the empty one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pending, goes_on = None, None, False
        schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("conversation_id", pa.int64()), ("depth", pa.int32()),
                            ("chars", pa.int64()), ("reach", pa.int64()), ("ends", pa.bool_())])

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            made = []
            for part, conversation, key, chars in _rows(batch):
                if state is None:
                    state, goes_on = states[part]
                if state.conversation != conversation:
                    if pending:
                        made.append((*pending, True))
                    state = State(conversation)
                    pending = (state.digest.to_bytes(16), None, conversation, 0, 0, 0)
                if key is not None:
                    if pending:
                        made.append((*pending, False))
                    parent = state.digest.to_bytes(16)
                    state = State(conversation, state.depth + 1, (state.digest * STEP + int.from_bytes(key) + 1) % PRIME, state.reach + chars)
                    pending = (state.digest.to_bytes(16), parent, conversation, state.depth, chars, state.reach)
            if made:
                yield batch_of(made)
        if pending:
            yield batch_of([(*pending, not goes_on)])

    return run


def visits_of(turns: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every start of every conversation: its digest, its parent's, its last turn's and all turns' characters."""
    columns = ["conversation_id", *order]
    ranged = turns.where("conversation_id IS NOT NULL").repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = saved(ranged.select(F.spark_partition_id().alias("part"), "conversation_id", "key", "chars"))
    sums = placed.mapInArrow(_sums, "part int, last int, conversation_id long, depth long, digest binary, reach long")
    states = carried(sums.orderBy("part", "last").collect())
    return written(placed.mapInArrow(_walk(states), VISIT), "conversation-starts")


def _cells(digests: pa.Array) -> np.ndarray:
    """(rows, n): the counters of each digest."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    a, b = (halves[:, k] * np.uint64(0x9E3779B97F4A7C15) for k in (0, 1))
    a, b = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(29))
    return np.stack([(a + np.uint64(k) * (b | np.uint64(1))) >> np.uint64(64 - SKETCH_BITS) for k in range(SKETCH_ROWS)])


def _bit(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (cells >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketch with counters of none, one, more: non-empty pieces of its two bit planes."""
    size = 1 << (SKETCH_BITS - 3)
    ones, twos = np.zeros((SKETCH_ROWS, size), np.uint8), np.zeros((SKETCH_ROWS, size), np.uint8)
    for batch in batches:
        for row, cells in enumerate(_cells(batch.column(0)) if batch.num_rows else ()):
            distinct, times = np.unique(cells, return_counts=True)
            at, bit = _bit(distinct)
            again = (ones[row, at] & bit > 0) | (times > 1)
            np.bitwise_or.at(twos[row], at[again], bit[again])
            np.bitwise_or.at(ones[row], at, bit)
    pieces = zip(ones.reshape(-1, PIECE), twos.reshape(-1, PIECE))
    for piece, (one, two) in enumerate(pieces):
        if one.any():
            arrays = [pa.array([piece], pa.int32()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["piece", "ones", "twos"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by piece: the counters of all tasks that reach two."""
    piece, ones, twos = None, None, None

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([twos.tobytes()], pa.binary())], ["piece", "twos"])

    for batch in batches:
        for own, one, two in _rows(batch):
            one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            if own == piece:
                ones, twos = ones | one, twos | two | (ones & one)
            else:
                if piece is not None:
                    yield found()
                piece, ones, twos = own, one, two
    if piece is not None:
        yield found()


def shared_bits(visits: DataFrame) -> np.ndarray:
    """The sketch as one bit a counter: whether two or more starts fell on it. Its size is fixed."""
    counted = visits.select("node").mapInArrow(_count, "piece int, ones binary, twos binary")
    merged = counted.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece int, twos binary")
    bits = np.zeros((SKETCH_ROWS << (SKETCH_BITS - 3)) // PIECE * PIECE, np.uint8).reshape(-1, PIECE)
    for row in merged.collect():
        bits[row.piece] = np.frombuffer(row.twos, np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def screened(visits: DataFrame, bits: np.ndarray) -> DataFrame:
    """Visits with ``possible`` (the start may be shared) and ``first`` (no earlier start of its conversation is known as proven).

    What follows a proven start is proven too; where a file ends between them the sketch is asked again.
    """
    held = visits.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            crowded = np.ones(batch.num_rows, bool)
            for row, cells in enumerate(_cells(batch.column(0))):
                at, bit = _bit(cells)
                crowded &= held.value[row, at] & bit > 0
            possible, first = [], []
            for conversation, depth, open_still in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), crowded.tolist()):
                tail = before[2] and before[0] == conversation and before[1] + 1 == depth
                alone = tail or not open_still
                possible.append(not alone)
                first.append(alone and not tail)
                before = (conversation, depth, alone)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(possible), pa.array(first)], [*batch.schema.names, "possible", "first"])

    return visits.mapInArrow(run, f"{VISIT}, possible boolean, first boolean")


@dataclass
class Trie:
    """``nodes``: one row a start; ``ends``: (``node``, ``conversation_id``) of conversations that end at a grouped node."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame, order: Sequence[str]) -> Trie:
    """The trie of all conversations.

    ``turns``: ``conversation_id``, ``key`` and ``chars`` (``turn_keys``) and the columns of ``order``, by which the turns of
    a conversation are read, nulls first; they should tell all rows apart, so that repeated rows can be cut
    between tasks. A row without key is no turn; it only makes its conversation known, so one without turns sits at
    the root. Rows without conversation_id take no part. Without conversations there is no node. Other columns are ignored.

    ``nodes``: ``node`` (digest), ``conversation_id`` (the smallest member), ``depth``, ``parent_id`` (the parent's smallest member; null at
    the root), ``n_conversations``, ``n_children``, ``n_leaves`` (nodes without child in the subtree), ``saved_chars`` (over
    the subtree, each node's other members times the characters of its last text), ``n_ends`` and ``grouped`` (false: proven
    to be of one conversation by the sketch; its ends are then its own).
    """
    visits = visits_of(turns, order)
    seen = screened(visits, shared_bits(visits))
    possible = written(seen.where("possible").drop("possible", "first"), "possible-starts")
    alone = seen.where("NOT possible")
    groups = possible.groupBy("node").agg(
        F.min("conversation_id").alias("member"), F.count("*").alias("n"), F.count_if("ends").alias("n_ends"),
        *[F.min(c).alias(c) for c in ("parent", "depth", "chars", "reach")],
    )
    groups = written(groups, "grouped-starts")
    below = alone.where("first").select("parent").unionByName(groups.select("parent")).where("parent IS NOT NULL")
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    groups = groups.join(children, "node", "left").na.fill(0, ["n_children"])
    groups = written(groups, "starts-with-children")

    # of each conversation: the characters up to where it is its node's smallest member, and whether it stands for a leaf
    named = written(attached(possible, groups.select("node", "member", "n_children"), ["node"], F.col("conversation_id")), "named-starts")
    other = F.col("conversation_id") != F.col("member")
    own_leaf = F.count_if("ends") == F.count_if(F.col("ends") & ~other & (F.col("n_children") == 0))
    paths = named.groupBy("conversation_id").agg(
        F.coalesce(F.max(F.when(other, F.col("reach"))), F.lit(0)).alias("through"), own_leaf.cast("int").alias("leaf")
    )
    totals = (
        attached(named.select("node", "conversation_id", "member", "depth"), paths, ["conversation_id"], F.col("depth"))
        .groupBy("node")
        .agg(F.sum(F.when(other, F.col("through")).otherwise(0)).alias("through"), F.sum("leaf").alias("n_leaves"))
    )
    saved_chars = F.col("through") - (F.col("n") - 1) * (F.col("reach") - F.col("chars"))
    grouped = groups.join(totals, "node").select(
        "node", "parent", "member", "depth", "n", "n_children", "n_leaves", saved_chars.alias("saved_chars"), "n_ends", F.lit(True).alias("grouped")
    )
    tails = alone.select(
        "node", "parent", F.col("conversation_id").alias("member"), "depth", F.lit(1).cast("long").alias("n"),
        (~F.col("ends")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_chars"),
        F.col("ends").cast("long").alias("n_ends"), F.lit(False).alias("grouped"), "first",
    )
    asked = grouped.unionByName(tails.where("first").drop("first"))
    parents = groups.select(F.col("node").alias("parent"), F.col("member").alias("parent_member"))
    linked = attached(asked, parents, ["parent"], F.col("node")).unionByName(
        tails.where("NOT first").drop("first").withColumn("parent_member", F.col("member"))
    )
    nodes = linked.select(
        "node",
        F.col("member").alias("conversation_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_member", "member")).alias("parent_id"),
        F.col("n").alias("n_conversations"),
        "n_children",
        "n_leaves",
        "saved_chars",
        "n_ends",
        "grouped",
    )
    return Trie(nodes, possible.where("ends").select("node", "conversation_id"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by node and id: the ids of each as a few texts."""
    node, ids, size = None, [], 0

    def text() -> pa.RecordBatch:
        arrays = [pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(arrays, ["node", "low", "ids"])

    for batch in batches:
        for own, conversation in _rows(batch):
            if ids and (own != node or size > JOINED):
                yield text()
                ids, size = [], 0
            node = own
            ids.append(conversation)
            size += 20
    if ids:
        yield text()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by node and lowest id: one hash a node, fed text by text."""
    node, sha = None, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for own, _, ids in _rows(batch):
            if own == node:
                sha.update(b",")
            else:
                if node is not None:
                    yield result()
                node, sha = own, hashlib.sha256()
            sha.update(ids.encode())
    if node is not None:
        yield result()


def end_digests(trie: Trie) -> DataFrame:
    """Nodes with ``ends_sha256``: SHA-256 of the ids that end there, ascending, comma-joined.

    The ids of a node are joined to texts by ranges of ids, in many tasks, and only these few texts are hashed in order.
    """
    texts = (
        trie.ends.repartitionByRange("node", "conversation_id")
        .sortWithinPartitions("node", "conversation_id")
        .mapInArrow(_joined, "node binary, low long, ids string")
    )
    hashed = texts.repartition("node").sortWithinPartitions("node", "low").mapInArrow(_hashed, "node binary, ends_sha256 string")
    none = F.sha2(F.lit("").cast("binary"), 256)
    shared = trie.nodes.where("grouped").join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    own = F.when(F.col("n_ends") > 0, F.sha2(F.col("conversation_id").cast("string").cast("binary"), 256)).otherwise(none)
    return shared.unionByName(trie.nodes.where("NOT grouped").withColumn("ends_sha256", own))
