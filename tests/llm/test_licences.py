"""Licence scans against plain searches."""

import random

from pyspark.sql import functions as F

from movara.llm.common import words
from movara.llm.licences import PHRASES, TEMPLATES, Library, SuffixAutomaton, scan_licences

MIT, APACHE = TEMPLATES[0][1], TEMPLATES[1][1]


def places(text: str | None) -> list[tuple[int, str]]:
    tokens = words((text or "").encode())
    return sorted(
        (at, label)
        for phrase, label in PHRASES
        for at in range(len(tokens))
        if tokens[at : at + len(phrase.split())] == phrase.encode().split()
    )


def test_matching_statistics_of_random_sequences():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        machine = SuffixAutomaton(texts)
        held = {(tuple(t[a:b])): None for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        asked = [rng.randint(1, 4) for _ in range(40)]
        state = matched = 0
        for at, token in enumerate(asked):
            while state and token not in machine.next[state]:
                state = machine.link[state]
                matched = machine.length[state]
            state = machine.next[state].get(token, 0)
            matched = matched + 1 if state else 0
            longest = max((n for n in range(at + 2) if n == 0 or tuple(asked[at + 1 - n : at + 1]) in held))
            assert matched == longest
            if matched:
                here = asked[at + 1 - matched : at + 1]
                want = {(n, e) for n, t in enumerate(texts) for e in range(matched, len(t) + 1) if t[e - matched : e] == here}
                assert set(machine.ends[state]) == want and len(machine.ends[state]) == len(want)


def test_phrases_and_templates(spark):
    texts = [
        None,
        "",
        "Released under the MIT License. under-the-mit-license cc BY NC cc by nc",
        "apache license version 2 " * 500,
        f"intro\n{MIT}\ntail",
        MIT[: len(MIT) // 3],
        "é " + APACHE.replace("compliance", "full and strict compliance").upper(),
        "the license of the software and the terms " * 50,
        "This work is licensed under the GNU General Public License, version 3.",
        "x " * 100_000 + "under the mit license",
    ]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "dataset_id long, content string, score double")
    got = {r.dataset_id: r for r in scan_licences(frame).collect()}
    for i, text in enumerate(texts):
        assert [(p.start, p.label) for p in got[i].phrases] == places(text), i
        assert got[i].n_words == len(words((text or "").encode()))
    labels = {i: {s.label for s in r.licences} for i, r in got.items()}
    assert labels[4] == {"mit-text"} and labels[5] == set() and labels[7] == set() and labels[8] == {"gpl-3"}
    assert labels[6] == {"apache-2-notice", "apache-2"}
    span = got[4].licences[0]
    assert texts[4][span.start : span.end].startswith("Permission") and texts[4][: span.end].endswith("Software")
    assert got[0].score == 0 and got[4].score == 1


def test_real_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frame = documents.select(F.col("doc_id").alias("dataset_id"), F.col("text").alias("content"))
    rows = scan_licences(frame, carry=("dataset_id", "content")).collect()
    assert all([(p.start, p.label) for p in r.phrases] == places(r.content) for r in rows)
    assert any(r.phrases for r in rows)


def test_empty_table(spark):
    assert scan_licences(spark.createDataFrame([], "dataset_id long, content string")).count() == 0


def test_every_template_covers_itself():
    library = Library()
    for label, text in TEMPLATES:
        assert label in {s[0] for s in library.scan(words(text.encode()))[1]}, label
