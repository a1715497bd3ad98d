"""Fingerprints, links and groups against plain versions."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from movara.llm import simhash
from movara.llm.components import components
from movara.llm.simhash import close_links, fingerprint, forest, near_copies

from tests.llm.plain import frame, tokens


def plain_print(text, size=3):
    found = tokens(text)
    shingles = [" ".join(found[i : i + size]) for i in range(len(found) - size + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(rng, n):
    """Prints with chains of small steps, so that groups are longer than the radius."""
    made = [rng.getrandbits(64)]
    while len(made) < n:
        near = rng.choice(made)
        for _ in range(rng.randint(1, 5)):
            near ^= 1 << rng.randrange(64)
        made.append(near if rng.random() < 0.7 else rng.getrandbits(64))
    return list(dict.fromkeys(made))


def test_fingerprint():
    for text in ("", " \t", "One two", "a b c d e A B C", "é 🙂 x y z " * 40):
        assert fingerprint(text.encode()) % 2**64 == plain_print(text), text


def test_bit_sliced_forest_connects_all_pairs():
    for seed in range(5):
        prints = clustered(random.Random(seed), 400)
        links = forest(np.array(prints, np.uint64), 3)
        assert len(links) < len(prints)
        at = {p: i for i, p in enumerate(prints)}
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links.tolist():
            a, b = find(at[a]), find(at[b])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(prints))] == plain_groups(prints)


def test_links_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(simhash, "LANES", 8)
    prints = clustered(random.Random(9), 500)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = close_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 3)
    roots = {r.node: r.root for r in components(links).collect()}
    got = {}
    for i, p in enumerate(signed):
        got.setdefault(roots.get(p, p), []).append(i)
    want = {}
    for i, g in enumerate(plain_groups(prints)):
        want.setdefault(g, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 600), (600, 700)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 700: 600}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    rows = near_copies(frame(spark)).collect()
    assert len(rows) == 9
    groups = {}
    for r in rows:
        groups.setdefault(r.component_id, []).append(r.dataset_id)
    assert sorted(groups[2]) == [2, 3, 7] and groups[1] == [1, 1] and set(groups[4]) == {4, None}
    assert near_copies(frame(spark, [])).count() == 0


def test_real_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = near_copies(documents.select(F.col("doc_id").alias("dataset_id"), F.col("text").alias("content"))).collect()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = [plain_print(texts[i]) for i in ids]
    want = {i: (p, ids[g]) for i, p, g in zip(ids, prints, plain_groups(prints))}
    assert {r.dataset_id: (r.fingerprint % 2**64, r.component_id) for r in rows} == want
