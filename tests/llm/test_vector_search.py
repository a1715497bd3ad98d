"""Exact top-k against all products."""

import math
import random

import numpy as np

from movara.llm import vector_search as module
from movara.llm.vector_search import Approximation, approximated, top_inner_products

SCHEMA = "vector_id long, vector array<float>"


def plain(rows, asked, k, scale=64):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    cells = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in cells:
        if q in asked:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in cells if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def answers(spark, rows, ids, k, **sizes):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = top_inner_products(vectors, vectors.where(vectors.vector_id.isin(ids)), k, **sizes)
    return sorted(tuple(r) for r in found.collect())


def test_blocks_and_ties(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-1, -0.5, 0, 0.25, 1])) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 400)]  # one vector many times
    asked = list(range(0, 400, 20))
    for sizes in ({}, {"block": 37, "asked": 5}):
        assert answers(spark, rows, asked, 7, **sizes) == plain(rows, asked, 7)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, []), (4, []), (5, []),
        (None, [1.0, 1.0]), (1, [3.0, 4.0]), (2, [1.0]), (3, [-1e9, 1e9]), (120, [5.0]),
    ]
    asked = [0, 20, 40, 60, 80, 100, 120]
    assert answers(spark, rows, asked, 3) == plain(rows, asked, 3)
    assert answers(spark, [], asked, 3) == []


def test_repeated_rows_each_count(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]
    assert answers(spark, rows, [0], 5) == [(0, 1, 1, 8192), (0, 1, 1, 8192), (0, 2, 1, 8192), (0, 2, 1, 8192)]


def test_bounds_hold_and_cells_are_small():
    rng = np.random.default_rng(7)
    for values in (rng.integers(-40, 40, (301, 7)), rng.integers(-(2**62), 2**62, (90, 5)), np.full((3, 2), 9), np.zeros((4, 0), int)):
        stored = approximated(values)
        assert len(stored["cells"]) == -(-values.size // 2)
        asked = values[::3].astype(np.float64)
        about, margin = Approximation({name: part.tobytes() for name, part in stored.items()}).bounds(asked)
        exact = values[::3].astype(object) @ values.T.astype(object)
        for i, j in np.ndindex(about.shape):
            assert abs(float(exact[i, j]) - about[i, j]) <= margin[i, j]


def test_the_kth_score_of_earlier_blocks_saves_exact_reads(monkeypatch):
    rng = np.random.default_rng(8)
    values, read = np.floor(rng.normal(0, 8, (2000, 64))).astype(np.int8), []
    plain_products = module.products
    monkeypatch.setattr(module, "products", lambda some, one: read.append(len(some)) or plain_products(some, one))
    ids, asked = np.arange(2000), values[::50].astype(np.int64)
    halves = []
    for at in (0, 1000):
        part = values[at : at + 1000]
        cells = Approximation({name: x.tobytes() for name, x in approximated(part.astype(np.int64)).items()})
        halves.append((ids[at : at + 1000], part, cells.bounds(asked.astype(np.float64))))
    alone = carried = 0
    for q in range(len(asked)):
        held = module.NOTHING
        for own, part, (about, margin) in halves:
            read.clear()
            module.best(about[q], margin[q], asked[q], own, part, module.NOTHING, 20)
            alone += sum(read)
            read.clear()
            held = module.best(about[q], margin[q], asked[q], own, part, held, 20)
            carried += sum(read)
        scores = values.astype(np.int64) @ asked[q]
        order = np.lexsort((ids, -scores))[:20]
        assert held[0].tolist() == order.tolist() and held[1].tolist() == scores[order].tolist()
    assert carried < 0.9 * alone and alone < 0.6 * 2000 * len(asked)
