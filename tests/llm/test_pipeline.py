"""The stages against plain versions on a small table, and awkward documents through all of them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from movara.llm.common import hashed_sample

from tests.llm.plain import words
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_texts import plain_firsts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema)
    return out


def test_quality_keeps_the_accepted(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    known = [r.doc_id for r in stages[0] if r.doc_id in labels]
    assert all(i in kept for i in known if labels[i] == 1)
    assert sum(i in kept for i in known if labels[i] == 0) <= 2


def test_one_of_each_group(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == [rows[i].doc_id for i in plain_firsts([r.text for r in rows])]


def test_no_quotes_remain(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        asked = words(r.text)
        windows |= {tuple(asked[i : i + 10]) for i in range(max(1, len(asked) - 9))}
    clean = [r.doc_id for r in stages[2] if not any(tuple(words(r.text)[i : i + 10]) in windows for i in range(len(words(r.text))))]
    assert sorted(r.doc_id for r in stages[3]) == sorted(clean) and len(clean) < len(stages[2])


def test_mix_and_shards(stages):
    sizes, taken = {}, {}
    for r in stages[3]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in stages[4]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken.get(s, 0) - t) <= max(50, 0.2 * t) for s, t in plain_targets(sizes).items())
    assert all(list(r.asDict()) == COLUMNS for out in stages[:5] for r in out[:1])
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    slots = {}
    for r in stages[5]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_awkward_documents(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(50))
    rows = [(i, text(), "en", "a", 1, "x", 1) for i in range(30)]
    rows += [(1, rows[1][1], "en", "a", 1, "x", 1), (50, None, None, None, None, None, None), (51, "", "", "", 0, "", 0), (None, text(), "en", None, 1, "x", 1), (52, "w " * 50_000, "en", "b", 1, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, size int")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        assert set(docs.columns) <= set(out.columns)
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0, name
        docs = docs if number == 0 else spark.createDataFrame(out.collect(), out.schema)


def test_run_reads_what_it_wrote(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[5])


def test_hashed_sample(spark):
    numbers = spark.range(5000)
    got = [r.id for r in hashed_sample(numbers, F.xxhash64("id"), 50).collect()]
    want = [r.id for r in numbers.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert sorted(got) == sorted(want) and hashed_sample(numbers.limit(3), F.xxhash64("id"), 50).count() == 3
