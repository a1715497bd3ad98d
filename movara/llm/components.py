"""Connected components of a link table, as rounds of joins over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.functions.sharing import written

#: Links of a task that are drawn together at once.
LINKS = 1 << 20


def drawn_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links from every node but the roots to the smallest node that it reaches, and whether any link is not among the given ones.

    A root that has a smaller neighbour joins it, so each pass at least halves the roots that are left to join.
    """
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(names))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        if (high == low).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(len(names)))
    # every root is the smaller end of a link; another smaller end has been joined to it
    return names[linked], names[root[linked]], len(np.unique(root)) < len(np.unique(b))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (a, b, moved) of a task: the same components by fewer links; a node has one link to a smaller node for each ``LINKS`` rows."""

    def made() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        a, b, changed = drawn_together(rows.column(0).to_numpy(), rows.column(1).to_numpy())
        moved = changed or bool(rows.column(2).to_numpy().any())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), moved))], ["a", "b", "moved"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LINKS:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _together(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "moved").mapInArrow(_drawn, "a long, b long, moved boolean")


def _starred(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star; edges run from the larger node ``a`` to the smaller ``b``.

    ``moved`` tells whether the round changed anything where the edge comes from. Between the stars each task draws its edges together, so
    few edges of a node are left for the small star however many the node had.
    """
    lowest = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
    large = edges.join(lowest, edges.b == lowest.node, "left").select(
        "a", F.coalesce("low", "b").alias("b"), F.col("low").isNotNull().alias("moved")
    )
    ends = _together(large).groupBy("a").agg(F.collect_set("b").alias("ends"), F.max("moved").alias("moved"))
    low = F.array_min("ends")
    return ends.select(
        F.explode(F.array_append(F.array_remove("ends", low), F.col("a"))).alias("a"),
        low.alias("b"),
        (F.col("moved") | (F.size("ends") > 1)).alias("moved"),
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (``node``, ``root``): every linked node but the roots with its component's smallest node.

    Null ends, self links and repeated links have no effect. The rounds end when a round changes
    nothing; their number grows with the logarithm of the longest chain. A round deals its edges three times,
    and reads them from a table, small files together, so few edges take few tasks.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved"))
    edges = written(_together(ordered), "links")
    while edges.agg(F.max("moved")).first()[0]:
        edges = written(_starred(edges), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
