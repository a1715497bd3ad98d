"""Exact top-k inner products with a vector-approximation file.

The file is a table of blocks, written once: next to the exact integers each block keeps the cells of its vectors, four bits
a component, and each vector's distance from the middle of its cells. A block answers queries by scanning the cells for
bounds of the inner product, then reading exact vectors in the order of their bounds until the k-th result is certain. A
task carries every query's k-th score from block to block, so later blocks read less and a task returns k rows a query,
however many blocks it saw.

The operator is general: the library's own records have no vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.sharing import written

#: Vectors in a block, queries in a block, queries bounded at once, steps of the grid, exact vectors read at once.
BLOCK = 8192
ASKED = 4096
AT_ONCE = 256
CELLS = 16
READ = 64
#: Query blocks whose best a task holds; blocks that one line of the grid takes, beyond as many lines.
HELD = 32
LINE, LINES = 16, 64

#: Inner products up to this size are exact as doubles.
EXACT = 2.0**53


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for a vector with null or non-finite components."""
    value = vector.cast("array<double>")
    broken = F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(
        value.isNotNull() & ~broken, F.transform(value, lambda x: F.floor(x * scale).cast("long"))
    )


def approximated(values: np.ndarray) -> dict[str, np.ndarray]:
    """The cells of a block (two a byte), each component's lowest value and step, each vector's distance from its middle."""
    exact = values.astype(np.float64)
    low = exact.min(axis=0)
    step = (exact.max(axis=0) - low) / CELLS
    cells = np.minimum((exact - low) // np.where(step > 0, step, 1.0), CELLS - 1).astype(np.uint8)
    flat = np.append(cells.ravel(), np.zeros(cells.size % 2, np.uint8))
    return {
        "cells": flat[0::2] | flat[1::2] << 4,
        "low": low,
        "step": step,
        "away": np.linalg.norm(exact - (low + (cells + 0.5) * step), axis=1),
    }


def _pack(rows: int, cells: bool):
    """Vectors of a task to blocks of at most ``rows`` vectors of one length, with their cells if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(size)))
            kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.array_equal(values.astype(t), values))
            kept = {"kind": np.dtype(kind).name, "ids": ids.tobytes(), "values": values.astype(kind).tobytes()}
            if cells:
                kept |= {name: part.tobytes() for name, part in approximated(values).items()}
            return pa.RecordBatch.from_pylist([{"size": size, **kept}])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths(), np.int64)
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                ids = part.column(0).to_numpy().astype(np.int64)
                values = part.column(1).flatten().to_numpy().astype(np.int64).reshape(len(ids), size)
                for at in range(0, len(ids), rows):
                    held.setdefault(int(size), []).append((ids[at : at + rows], values[at : at + rows]))
                    if sum(len(x) for x, _ in held[int(size)]) >= rows:
                        yield block(int(size))
        for size in list(held):
            yield block(size)

    return run


def blocks(vectors: DataFrame, rows: int, cells: bool) -> DataFrame:
    """The written table of blocks (``block``, ``size``, ``kind``, ``ids``, ``values``; cells), packed where the vectors are read."""
    fields = "size long, kind string, ids binary, values binary"
    if cells:
        fields += ", cells binary, low binary, step binary, away binary"
    tasks = max(1, -(-vectors.count() // rows))
    packed = vectors.coalesce(tasks).mapInArrow(_pack(rows, cells), fields)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "vectors")


class Approximation:
    """The cells of a stored block."""

    def __init__(self, row: dict):
        self.low, self.step, self.away = (np.frombuffer(row[x], np.float64) for x in ("low", "step", "away"))
        packed = np.frombuffer(row["cells"], np.uint8)
        both = np.empty(2 * len(packed))
        both[0::2], both[1::2] = packed & 15, packed >> 4
        shape = len(self.away), len(self.low)
        self.cells = both[: shape[0] * shape[1]].reshape(shape)

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the middles (asked, vectors), and by how much the exact ones may differ.

        The difference is an inner product with what lies between vector and middle: at most the product of both
        lengths, and at most half a step in each component. Rounding is bounded by the sum of all terms' sizes.
        """
        scaled = asked * self.step
        about = (asked @ (self.low + self.step / 2))[:, None] + scaled @ self.cells.T
        terms = np.abs(asked) @ (np.abs(self.low) + CELLS * self.step)
        rounding = (len(self.low) + 8) * 2.0**-50 * terms + 1e-6
        sides = np.abs(scaled).sum(axis=1) / 2
        lengths = np.linalg.norm(asked, axis=1)[:, None] * self.away
        return about, np.minimum(lengths, sides[:, None]) + rounding[:, None]


Found = tuple[np.ndarray, np.ndarray]
NOTHING: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def products(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact integer inner products of some stored vectors with a query."""
    largest = np.abs(asked.astype(np.float64)).max(initial=0) * np.abs(values.astype(np.float64)).max(initial=0)
    if largest * values.shape[1] < EXACT:
        return (values.astype(np.float64) @ asked.astype(np.float64)).astype(np.int64)
    return values.astype(np.int64) @ asked


def best(about: np.ndarray, margin: np.ndarray, asked: np.ndarray, ids: np.ndarray, values: np.ndarray, held: Found, k: int) -> Found:
    """A query's best k (ids, scores) of those held and the block's, in order; ``about`` is -inf for its own row."""
    take = min(k, int(np.isfinite(about).sum()))
    if not take:
        return held
    # neither what the k-th held score excludes nor what the k-th largest lower bound does can be among the best
    kth = held[1][-1] if len(held[1]) == k else -np.inf
    upper = about + margin
    rest = np.flatnonzero(upper >= max(kth, np.partition(about - margin, -take)[-take]))
    rest = rest[np.argsort(-upper[rest], kind="stable")]
    at = 0
    while at < len(rest) and upper[rest[at]] >= kth:
        part = rest[at : at + READ]
        at += len(part)
        found, scores = np.append(held[0], ids[part]), np.append(held[1], products(values[part], asked))
        order = np.lexsort((found, -scores))[:k]
        held = found[order], scores[order]
        kth = held[1][-1] if len(order) == k else -np.inf
    return held


def _numbers(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return ids, np.frombuffer(row[prefix + "values"], row[prefix + "kind"]).reshape(len(ids), row["size"])


def _answers(k: int):
    def rows(block: int, own: np.ndarray, held: list[Found]) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(own)), [len(x) for x, _ in held])
        vector, score = (np.concatenate(x) for x in zip(*held))
        columns = own[place], np.full_like(place, block), place, vector, score
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in columns], ["query_id", "asked_block", "place", "vector_id", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, list[Found]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own, asked = _numbers(row, "asked_")
                asked = asked.astype(np.int64)
                ids, values = _numbers(row)
                approximation = Approximation(row)
                if row["asked_block"] not in kept and len(kept) >= HELD:
                    oldest = next(iter(kept))
                    yield rows(oldest, *kept.pop(oldest))
                _, held = kept.setdefault(row["asked_block"], (own, [NOTHING] * len(own)))
                for first in range(0, len(own), AT_ONCE):
                    part = slice(first, first + AT_ONCE)
                    about, margin = approximation.bounds(asked[part].astype(np.float64))
                    about[own[part, None] == ids] = -np.inf  # the query's own row
                    for i in range(len(about)):
                        q = first + i
                        held[q] = best(about[i], margin[i], asked[q], ids, values, held[q], k)
        for block, (own, held) in kept.items():
            yield rows(block, own, held)

    return run


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block: int = BLOCK, asked: int = ASKED
) -> DataFrame:
    """Each query's ``k`` highest integer inner products over all vectors but those of its own id.

    ``vectors`` and ``queries``: ``vector_id``, ``vector`` (array of numbers); components become
    floor(``scale`` * x). Returns ``query_id``, ``rank`` from 1, ``vector_id``, ``score``; ties go to the
    smaller id, and a query with fewer candidates returns all of them.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without id;
    vectors of another length are no candidates; empty vectors score 0 among themselves. Repeated rows count each: a repeated query answers
    each time, a repeated vector takes several ranks. Scores are 64-bit integers.
    """
    usable = lambda df: (
        df.select("vector_id", integer_components(F.col("vector"), scale).alias("components"))
        .where("vector_id is not null and components is not null")
    )
    stored = blocks(usable(vectors), block, True)
    asking = blocks(usable(queries), asked, False).select(
        "size", *[F.col(c).alias(f"asked_{c}") for c in ("block", "kind", "ids", "values")]
    )
    # every block of vectors meets every block of queries: both are copied along a grid and joined on its cells
    wide, high = (min(n, max(LINES, -(-n // LINE))) for n in (max(stored.count(), 1), max(asking.count(), 1)))
    # a fixed number of tasks: the joined bytes are few for the work they hold
    tasks = min(2 * wide * high, 16 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    along = ["size", "x", "y"]
    left = stored.withColumn("x", cell("block", wide)).withColumn("y", line(high)).repartition(tasks, *along)
    right = asking.withColumn("y", cell("asked_block", high)).withColumn("x", line(wide)).repartition(tasks, *along)
    met = left.join(right, along)
    local = met.mapInArrow(_answers(k), "query_id long, asked_block long, place long, vector_id long, score long")
    # a query is one place of one block: repeated queries stay apart
    rank = F.row_number().over(
        Window.partitionBy("query_id", "asked_block", "place").orderBy(F.desc("score"), "vector_id")
    )
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vector_id", "score")
