"""Components against a plain union, links drawn together in small parts, and what a round deals out."""

import random

import numpy as np
import pytest

from movara.llm import components as module
from movara.llm.components import components, drawn_together

LINKS = "a long, b long"


def plain_roots(links):
    label = {}

    def top(n):
        while label.get(n, n) != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {n: top(n) for n in {n for link in links for n in link} if top(n) != n}


def graphs():
    rng = random.Random(8)
    loose = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)]
    chain = list(range(400))
    rng.shuffle(chain)
    hubs = [(n, hub) for n in range(1, 400) for hub in (0, 1000)[: 1 + n % 2]]
    return {"loose": loose, "chain": list(zip(chain, chain[1:])), "hubs": hubs, "far": [(2**63 - 1, -(2**63)), (-(2**63), 7), (7, 7)]}


def test_links_drawn_together():
    for links in graphs().values():
        ends = np.array([(max(p), min(p)) for p in links if p[0] != p[1]], np.int64)
        a, b, changed = drawn_together(ends[:, 0], ends[:, 1])
        found = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert found == plain_roots(links) and len(found) == len(a)
        again = drawn_together(a, b)
        assert changed == (not set(found.items()) <= set(map(tuple, ends.tolist()))) and not again[2]
        assert dict(zip(again[0].tolist(), again[1].tolist())) == found


@pytest.mark.parametrize("name", list(graphs()))
def test_small_parts_meet(spark, monkeypatch, name):
    """However few links a task holds together, and with each link twice."""
    monkeypatch.setattr(module, "LINKS", 1)
    links = graphs()[name]
    frame = spark.createDataFrame(links + links[::-1], LINKS).repartition(5)
    rows = components(frame).collect()
    assert {r.node: r.root for r in rows} == plain_roots(links) and len(rows) == len({r.node for r in rows})


def test_few_links_take_few_tasks(spark):
    """The edges are read in few tasks and dealt three times a round, so tasks and their files stay few whatever the shuffle partitions."""
    links = spark.createDataFrame(graphs()["loose"], LINKS).repartition(4)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context, asked, real = spark.sparkContext, [], module.written
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "written", lambda df, purpose: asked.append(df) or real(df, purpose))
            context.setJobGroup("few-links", "")
            assert components(links).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    plans = [str(df._jdf.queryExecution().executedPlan().toString()) for df in asked]
    assert all(p.count("Exchange hashpartitioning") <= 3 for p in plans[1:])
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert tasks <= 200 * len(asked)
