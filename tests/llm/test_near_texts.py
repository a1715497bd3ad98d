"""Near texts against all pairs, on planted copies of known similarity."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from movara.llm import near_texts as module
from movara.llm.near_texts import near_texts, one_per_text

from tests.llm.plain import frame

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_firsts(texts):
    """The smallest index of each group linked by a similarity of at least 0.8."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and similarity(texts[i], texts[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(set(label))


def planted(rng, originals=60):
    """Texts of 200 words, each with a copy in which 2 to 6 words far apart are changed: similarities of about 0.74 to 0.9."""
    texts = []
    for n in range(originals):
        found = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
        changed = list(found)
        for k in range(1 + n % 6):
            changed[10 + 30 * k] = f"other{n}x{k}"
        texts += [" ".join(found), " ".join(changed)]
    return texts


def documents(spark, texts):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_removes_planted_copies(spark):
    texts = planted(random.Random(3))
    near = [similarity(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert sum(0.8 <= s < 0.96 for s in near) >= 40 and sum(s < 0.8 for s in near) >= 10
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, texts), SF).collect()
    assert sorted(r.doc_id for r in kept) == plain_firsts(texts)


def test_repeated_line_is_no_copy(spark):
    rng = random.Random(4)
    line = "the very same line of words over and over again "
    texts = [line * 200 + " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(4)]
    texts += [None, "", "one two", "ONE  two", "one three"]
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, texts), SF).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3, 4, 6, 8]


def test_awkward_rows(spark):
    """Rows that repeat, without id or text, one very long text; of rows with one id and text the same record on every run."""
    uploads = frame(spark).withColumn("record", F.struct("dataset_id", "content"))
    assert sorted(r.record.dataset_id for r in one_per_text(uploads).collect()) == [1, 2, 4, 5, 6]
    groups = {}
    for r in near_texts(uploads).collect():
        groups.setdefault(r.group, []).append(r.dataset_id)
    assert sorted(map(len, groups.values())) == [1, 1, 2, 2, 3]
    assert near_texts(frame(spark, [])).count() == one_per_text(frame(spark, []).withColumn("record", F.struct("dataset_id"))).count() == 0
    rows = [(1, "the same words in every row of this text", n) for n in range(200)] + [(2, "the same words in every row of this text", 7)]
    repeated = spark.createDataFrame(rows, "dataset_id long, content string, other int").withColumn("record", F.struct("dataset_id", "content", "other"))
    kept = [one_per_text(repeated.repartition(n)).collect() for n in (1, 5)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0][0].record.dataset_id == 1


def test_large_clusters_in_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 8)
    rng = random.Random(5)
    found = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)]
    texts = []
    for n in range(60):
        found[rng.randrange(120)] = f"step{n}"
        texts.append(" ".join(found))
    rows = near_texts(documents(spark, texts).select(F.col("doc_id").alias("dataset_id"), F.col("text").alias("content"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group, []).append(r.dataset_id)
    assert sorted(min(g) for g in groups.values()) == plain_firsts(texts)


def test_real_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, [r.text for r in rows]), SF).collect()
    assert sorted(r.doc_id for r in kept) == plain_firsts([r.text for r in rows])


def test_copy_that_only_the_fingerprint_finds(spark):
    """A pair of similarity 47/57 that no MinHash band brings together, under one SimHash fingerprint."""
    found = (
        "a8d6a2 26808b 5cf3df ca1eba bd4831 f3c2fe bf472f fe762b b1af25 2a122c 147287 acfad6 bbb61c 2f45df 940d95 3d1feb c4da26 7253da 7435db d88962 "
        "9e0dfc fafdf5 dbef9b 93aad4 23a8d0 b8da00 bc6d24 5c3ce1 410657 deeb13 dedadf 62834b b90a9 30692a 3b3501 66e2d0 94930d 23543c 6e400a 8182c"
    ).split()
    line = "the very same line of words stands here over and over again " * 30
    texts = [line + " ".join(found), line + " ".join(found[:35] + [f"z{w}" for w in found[35:]])]
    keys = [module.band_keys(module.shingle_set(t.encode())) for t in texts]
    assert not (keys[0] == keys[1]).any() and similarity(*texts) >= 0.8
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, texts), SF).collect()
    assert [r.doc_id for r in kept] == plain_firsts(texts) == [0]


def test_bucket_links_take_one_shuffle_of_the_keys(spark, monkeypatch):
    """A key of a third of all nodes falls into several tasks and is still one component."""
    rows = [(n, n % 50 if n % 3 else 1000) for n in range(3000)] + [(n + 5000, n + 5000) for n in range(500)]
    keyed = spark.createDataFrame(rows, "node long, key long").repartition(5)
    asked, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df, purpose: asked.append(df) or real(df, purpose))
    found = module.candidate_links(keyed).collect()
    plan = asked[0]._jdf.queryExecution().sparkPlan()
    assert str(plan.toString()).count("rangepartitioning") == 1 and "Join" not in str(plan.toString())
    label = {}
    top = lambda n: n if label.get(n, n) == n else top(label[n])
    for r in found:
        label[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    groups = {}
    for node, key in rows:
        groups.setdefault(key, set()).add(top(node))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_text_meets_its_cluster_in_two_shuffles(spark):
    """Of the text: one to the cluster, copies put together before it, one to the cluster's parts."""
    uploads = spark.createDataFrame([(n, f"text {n % 4}") for n in range(20)], "dataset_id long, content string")
    keys = uploads.select("content", F.xxhash64("content").alias("content_key")).distinct()
    firsts = keys.select(F.col("content_key").alias("node"), "content_key")
    clusters = firsts.select("node", F.lit(0).cast("long").alias("cluster"))
    links = module.close_texts(uploads, firsts, clusters)
    tree = links._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"keys?=\[content_key", tree) and not re.search(r"keys?=\[node", tree)
    assert links.count() == 0
