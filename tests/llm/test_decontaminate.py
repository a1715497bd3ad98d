"""Decontamination against a plain window search."""

import random

from movara.llm.decontaminate import decontaminate

from tests.llm.plain import frame, words

QUESTIONS = "question_id string, content string"


def plain(text, questions, window=10):
    tokens, hit, ids = words(text), set(), set()
    for question_id, question in questions:
        asked = words(question)
        for at in range(max(1, len(asked) - window + 1) if asked else 0):
            pattern = asked[at : at + window]
            for start in range(len(tokens) - len(pattern) + 1):
                if tokens[start : start + len(pattern)] == pattern:
                    hit.update(range(start, start + len(pattern)))
                    ids.add(question_id or "")
    return len(tokens), len(hit), sorted(ids)


def random_case(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "c1", "é"]) for _ in range(n))
    questions = [(str(i), some(rng.randint(1, 8))) for i in range(4)]
    questions += [("0", questions[0][1]), (None, some(5)), ("n", None), ("e", " ;-")]
    texts = [(i, "f", some(rng.randint(0, 60)).replace(" ", rng.choice([" ", ", ", "\n--"]))) for i in range(12)]
    return questions, texts


def test_equals_plain_search(spark):
    for seed in range(3):
        questions, texts = random_case(seed)
        asked = spark.createDataFrame(questions, QUESTIONS)
        for limit in (16_000_000, 20):  # one automaton, then several
            rows = decontaminate(frame(spark, texts), asked, window=4, automaton_bytes=limit).collect()
            got = {r.dataset_id: (r.n_words, r.n_hit, r.question_ids) for r in rows}
            assert got == {i: plain(t, questions, 4) for i, _, t in texts}


def test_quotes_map_to_the_original(spark):
    quote = "What IS -- the\nTotal, of Região Sul (in 2024) for chairs & tables?"
    text = "🙂é before. " + quote + " After"
    rows = decontaminate(frame(spark, [(1, "f", text)]), spark.createDataFrame([("q", quote)], QUESTIONS)).collect()
    (span,) = rows[0].quotes
    assert text[span.start : span.end] == quote.rstrip("?")
    assert rows[0].question_ids == ["q"]


def test_awkward_rows(spark):
    questions = [("1", "table south 99"), ("2", "word " * 30)]
    rows = decontaminate(frame(spark), spark.createDataFrame(questions, QUESTIONS)).collect()
    assert len(rows) == 9
    by_id = {r.dataset_id: r for r in rows}
    assert by_id[4].n_hit == by_id[None].n_hit == 3 and by_id[6].n_hit == by_id[6].n_words == 60_000
    assert by_id[2].n_words == by_id[3].n_words == by_id[7].n_words == 0
    none = spark.createDataFrame([], QUESTIONS)
    assert all(r.n_hit == 0 for r in decontaminate(frame(spark), none).collect())
    assert decontaminate(frame(spark, []), spark.createDataFrame(questions, QUESTIONS)).count() == 0
