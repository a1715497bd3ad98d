"""Benchmark decontamination: uploads that quote test questions or answers.

Every run of ``window`` consecutive words of a test text is a pattern; a shorter text is one pattern.
All patterns go into one Aho-Corasick automaton whose letters are whole words, and each upload is
scanned once, whole. Word positions are mapped back to character offsets of the original text.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.llm.common import WORD, map_content, words

#: Test texts of more bytes than this are dealt to several automata, each built by the tasks in turn.
AUTOMATON_BYTES = 16_000_000


def test_windows(questions: list[tuple[str, bytes]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each pattern with the ids of the questions that hold it."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for question_id, content in questions:
        tokens = words(content)
        for at in range(max(1, len(tokens) - window + 1) if tokens else 0):
            ids = found.setdefault(tuple(tokens[at : at + window]), [])
            if not ids or ids[-1] != question_id:
                ids.append(question_id)
    return found


class Scanner:
    """The automaton over word numbers; 0 stands for every word that no pattern has."""

    def __init__(self, questions: list[tuple[str, bytes]], window: int):
        patterns = test_windows(questions, window)
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in patterns.items():
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in pattern)
            self.automaton.add_word(key, (len(key), ids))
        if patterns:
            self.automaton.make_automaton()
        self.shortest = min(map(len, patterns), default=0)

    def scan(self, tokens: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Occurrences as (first word, word after the last, question ids)."""
        if not self.shortest or len(tokens) < self.shortest:
            return []
        numbers = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        unknown = np.flatnonzero(numbers == 0)
        runs = np.diff(np.concatenate(([-1], unknown, [len(tokens)]))) - 1
        if runs.max() < self.shortest:  # no pattern holds an unknown word
            return []
        return [(end + 1 - n, end + 1, ids) for end, (n, ids) in self.automaton.iter(tuple(numbers.tolist()))]


def merged(occurrences: list[tuple[int, int, list[str]]]) -> list[list[int]]:
    """Word ranges that any occurrence covers, in order."""
    ranges: list[list[int]] = []
    for start, end, _ in sorted(occurrences, key=lambda x: x[:2]):
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([start, end])
    return ranges


def offsets(content: bytes, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Character offsets of word ranges in the original text, end exclusive."""
    spans = [m.span() for m in WORD.finditer(content.decode("utf-8", "replace"))]
    return [{"start": spans[a][0], "end": spans[b - 1][1]} for a, b in ranges]


def decontaminate(
    uploads: DataFrame,
    questions: DataFrame,
    window: int = 10,
    carry: tuple[str, ...] = ("dataset_id",),
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """What each upload quotes of the test questions.

    ``uploads``: ``content`` and the ``carry`` columns. ``questions``: ``question_id``, ``content`` (a test
    question or answer). Returns the carried columns, ``n_words``, ``n_hit`` (words inside any occurrence),
    ``question_ids`` (sorted, distinct) and ``quotes`` (character ranges of the original text).

    Missing or empty texts have no words and quote nothing; a question without words is ignored, one
    without id counts under the empty id; repeated questions count once, repeated uploads each keep their
    row. The questions are read to the driver in blocks of at most ``automaton_bytes`` (a single longer
    question is its own block); with several blocks every text is scanned once by each.
    """
    spark = uploads.sparkSession
    known = questions.where("content is not null").select(
        F.coalesce(F.col("question_id").cast("string"), F.lit("")).alias("question_id"),
        F.col("content").cast("binary").alias("content"),
    )
    total = known.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // automaton_bytes)) if total > automaton_bytes else 1
    dealt = known.withColumn("block", F.pmod(F.xxhash64("question_id", "content"), F.lit(blocks)))
    shared = [
        spark.sparkContext.broadcast(
            sorted({(r.question_id, bytes(r.content)) for r in dealt.where(F.col("block") == n).collect()})
        )
        for n in range(blocks)
    ]

    def start():
        scanners = [Scanner(part.value, window) for part in shared] if blocks == 1 else None

        def step(contents: list) -> dict[str, list]:
            tokens = [words(c) for c in contents]
            found: list[list] = [[] for _ in contents]
            for part in range(blocks):
                scanner = scanners[part] if scanners else Scanner(shared[part].value, window)
                for hits, text in zip(found, tokens, strict=True):
                    hits += scanner.scan(text)
            ranges = [merged(hits) for hits in found]
            return {
                "n_words": [len(t) for t in tokens],
                "n_hit": [sum(b - a for a, b in r) for r in ranges],
                "question_ids": [sorted({i for _, _, ids in hits for i in ids}) for hits in found],
                "quotes": [offsets(c, r) if r else [] for c, r in zip(contents, ranges, strict=True)],
            }

        return step

    fields = "n_words long, n_hit long, question_ids array<string>, quotes array<struct<start: long, end: long>>"
    return map_content(uploads, carry, fields, start, **({} if blocks == 1 else {"rows": 10_000}))
