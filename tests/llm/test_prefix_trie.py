"""The trie of conversation starts against a plain one."""

import hashlib
import random

import pytest

from movara.llm import prefix_trie as T
from movara.llm.prefix_trie import carried, end_digests, prefix_trie, turn_keys
from movara.llm.queries import op12
from movara.llm.registry import ORACLES

from tests.oracle import connect, differences

SCHEMA = "conversation_id long, turn long, role string, content string, row long, depth int, n int"
ORDER = ["turn", "key", "row"]


def trie(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, i, 7, 7) for i, r in enumerate(rows)], SCHEMA).repartition(parts)
    return prefix_trie(turn_keys(frame, "conversation_id", "turn", "row", "n"), ORDER)


def plain(rows):
    """(depth, member, parent's member, members, children, leaves, saved, ends) of every node."""
    spoken = {}
    for conversation, turn, role, content in rows:
        if conversation is not None:
            turns = spoken.setdefault(conversation, [])
            turns.append(((turn is not None, turn or 0), role or "", content or ""))
    paths = {}
    for c, turns in spoken.items():
        key = lambda t: (t[0], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
        paths[c] = tuple(t[1:] for t in sorted(turns, key=key))
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    found = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        found.append((len(node), min(own), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def result(made):
    names = ["depth", "conversation_id", "parent_id", "n_conversations", "n_children", "n_leaves", "saved_chars", "ends_sha256"]
    return sorted(map(tuple, end_digests(made).select(*names).collect()), key=repr)


def talk(seed, conversations, turns, said):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(said)) for c in range(conversations) for t in range(draw.randrange(turns))]


AWKWARD = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (2, 0, "user", "hello"), (2, 1, "assistant", "good day"), (2, 2, None, None),
    (3, None, "user", "hello"), (3, 1, "assistant", "other"), (4, 0, None, None), (5, 0, "", ""), (None, 0, "user", "hello"),
    (6, 0, "user", "hello"), (6, 0, "user", "hello"), (-7, 0, "useré", "🙂" * 5), (8, 0, "user", "word " * 200_000), (9, 0, "userhello", ""),
]


@pytest.mark.parametrize("rows", [AWKWARD, talk(1, 60, 7, ["a", "bb", "ccc", ""]), talk(2, 30, 12, ["a"]), [(1, 0, "user", "x")]])
def test_matches_plain_trie(spark, rows):
    assert result(trie(spark, rows)) == plain(rows)


def test_sketch_that_proves_nothing_changes_nothing(spark, monkeypatch):
    rows = talk(3, 50, 6, ["a", "bb", "ccc"])
    monkeypatch.setattr(T, "shared_bits", lambda visits: T.np.full((T.SKETCH_ROWS, 1 << (T.SKETCH_BITS - 3)), 255, T.np.uint8))
    made = trie(spark, rows)
    assert made.nodes.where("NOT grouped").count() == 0
    assert result(made) == plain(rows)


def test_most_tails_never_shuffle(spark):
    rows = [(c, t, "user", f"{c if t > 1 else 0}-{t}") for c in range(200) for t in range(6)]
    made = trie(spark, rows)
    assert made.nodes.where("grouped").count() <= 3 + 4  # the shared start, and what the sketch takes for shared
    assert result(made) == plain(rows)


def test_long_conversation_over_many_tasks(spark):
    """One conversation has nearly all rows; its turns are cut between tasks and carried on."""
    rows = [(1, t, "user", f"t{t}") for t in range(600)] + [(2, t, "user", f"t{t}") for t in range(300)] + [(3, 0, "user", "t0")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = trie(spark, rows)
        found = {(r.depth, r.conversation_id): r for r in made.nodes.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 601
    assert found[0, 1].saved_chars == sum(len(f"t{t}") for t in range(300)) + len("t0")
    assert found[300, 1].n_conversations == 2 and found[301, 1].n_conversations == 1
    assert {r.n_leaves for r in found.values()} == {1} and found[600, 1].n_children == 0


def test_states_are_carried_over_tasks():
    row = lambda part, last, c, depth, reach: T.F and type("Row", (), dict(part=part, last=last, conversation_id=c, depth=depth, digest=bytes(16), reach=reach))
    sums = [row(0, 0, 1, 2, 5), row(0, 1, 2, 1, 1), row(1, 0, 2, 3, 4), row(1, 1, 2, 3, 4), row(2, 0, 2, 0, 0), row(2, 1, 3, 1, 1)]
    states = carried(sums)
    assert [(s.conversation, s.depth, s.reach, more) for s, more in (states[p] for p in range(3))] == [
        (None, 0, 0, True), (2, 1, 1, False), (2, 4, 5, False),
    ]


def test_no_conversations(spark):
    assert result(trie(spark, [])) == []
    assert result(trie(spark, [(None, 1, "user", "x")])) == []


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op12(spark, sf), connect(sf), ORACLES["op12_prefix_trie"]) == []
