"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from movara.llm import collocations as C
from movara.llm.collocations import chunks_of, collocations
from movara.llm.queries import op13
from movara.llm.registry import ORACLES

from tests.llm.plain import AWKWARD, LOWER, frame
from tests.oracle import connect, differences


def pieces(text):
    parts = re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))
    return [re.findall("[^\x20\x09]+", p) for p in parts]


def plain(rows, least, most=2000, covered=80):
    """``rows``: (group, text)."""
    total, counts = Counter(), Counter()
    for group, text in rows:
        for words in pieces(text):
            total[group] += len(words)
            for n in range(1, 5):
                counts.update((group, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {}
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (group, phrase), a in frequent.items():
        cuts = [(2_000_000 * a // (counts[group, phrase[:k]] + counts[group, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        inside = [
            b for (g, longer), b in frequent.items()
            if g == group and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
        ]
        if not any(100 * b >= covered * a for b in inside):
            row = (" ".join(phrase), a, counts[group, phrase[:k]], counts[group, phrase[k:]], total[group], score)
            found.setdefault(group, []).append(row)
    ranked = []
    for group, own in found.items():
        own.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        ranked += [(group, i + 1, *r) for i, r in enumerate(own[:most])]
    return sorted(ranked, key=repr)


def result(made, by="file_name"):
    return sorted(map(tuple, made.select(by, "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=repr)


def written_rows(seed, texts):
    draw = random.Random(seed)
    words = ["one", "two", "THREE", "four", "fünf", "six\x00", "x" * 300]
    passage = " ".join(draw.choice(words) for _ in range(150))
    rows = []
    for i in range(texts):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".\r\n", "\x0b"]) for _ in range(draw.randrange(60)))
        rows.append((i, draw.choice(["a.csv", "b.csv", None]), text + (passage if i % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("rows, least", [(written_rows(1, 120), 5), (written_rows(2, 40), 2), (AWKWARD, 2)])
def test_matches_plain_counting(spark, rows, least):
    assert result(collocations(frame(spark, rows), least=least)) == plain([(f, t) for _, f, t in rows], least)


def test_limit_and_cover(spark):
    rows = written_rows(4, 60)
    assert result(collocations(frame(spark, rows), least=4, most=3, covered=50)) == plain([(f, t) for _, f, t in rows], 4, 3, 50)


def test_every_start_is_in_one_chunk():
    """Own words of all chunks are all words, also in runs without a picked word and in texts of one word."""
    texts = [b"word " * 5000, b"", None, b" a  b. c", b"x" * 100_000, b" ".join(b"w%d" % (i % 997) for i in range(9000))]
    found = chunks_of(texts, list(range(len(texts))))
    own = Counter()
    for (text, n, chunk), times in found.items():
        assert 0 < n <= C.MOST and n <= chunk.count(b" ") + 1 <= n + C.LONGEST - 1
        own[text] += n * times
    assert own == {0: 5000, 3: 3, 4: 1, 5: 9000}


def test_repeated_passages_are_one_entry(spark):
    passage = " ".join(f"w{i}" for i in range(2000))
    rows = [(i, "a.csv", f"Start {i}. {passage}") for i in range(50)]
    chunks = C.dictionary(frame(spark, rows), "file_name")
    assert chunks.count() < 2000 / 8 + 50
    assert chunks.where("times >= 50").count() > 2000 / 64


def test_long_text_is_read_in_portions(spark, monkeypatch):
    texts = [(1, "a.csv", "one two three. " * 2000)]
    expected = plain([(f, t) for _, f, t in texts], 30)
    monkeypatch.setattr(C, "SLICE_BYTES", 1000)
    assert [t for t, _ in C.portions([b"a" * 3000, b"ab. " * 500, None], [1, 2, 3])][0] == b"a" * 3000
    assert sum(len(t) for t, g in C.portions([b"ab. " * 500], [2])) + 3 >= 1990
    assert result(collocations(frame(spark, texts), least=30)) == expected


def test_no_rows(spark):
    assert result(collocations(frame(spark, []))) == []
    assert result(collocations(frame(spark, [(1, "a.csv", None), (2, None, "")]))) == []


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op13(spark, sf), connect(sf), ORACLES["op13_collocations"]) == []


def test_phrases_are_numbered_and_joined_at_once():
    """Numbers tell phrases apart also where the product of the words' numbers passes 64 bits; texts come from arrays."""
    import numpy as np
    import pyarrow as pa

    from movara.llm import collocations as module

    rng = np.random.default_rng(3)
    for names in (5, 1 << 20, 1 << 40):
        codes = [rng.integers(names - 3, names, 400) for _ in range(4)]
        group = rng.integers(0, 3, 400)
        number = module.phrase_numbers(group, 3, codes, names)
        whole = list(zip(group.tolist(), *(c.tolist() for c in codes)))
        assert len(set(number.tolist())) == len(set(whole)) == len(set(zip(number.tolist(), whole)))
    words = pa.array([b"a", b"\xc3\xa9t\xc3\xa9", b""], pa.binary())
    found = module.phrase_texts(words, [np.array([0, 1, 1]), np.array([1, 1, 2])])
    assert found.type == pa.binary() and found.to_pylist() == [b"a \xc3\xa9t\xc3\xa9", b"\xc3\xa9t\xc3\xa9 \xc3\xa9t\xc3\xa9", b"\xc3\xa9t\xc3\xa9 "]


def test_chunks_run_over_short_pieces():
    """Pieces of few words share a chunk; what a chunk sees of the next one ends with the piece."""
    draw = random.Random(7)
    for text in (" ".join(f"w{i}" + draw.choice(["", ".", " !", ". ,"]) for i in range(6000)), "  a  b. c " * 300):
        found = chunks_of([text.encode(), b" ", None], ["x", "y", "z"])
        assert sum(n * times for (_, n, _), times in found.items()) == sum(map(len, pieces(text)))
        assert sum(found.values()) < 6000 / 8
        for _, n, chunk in found:
            words = chunk.split(b" ")
            assert n <= len(words) < n + C.LONGEST and words[-1][-1:] != b"."
            assert not any(w.endswith(b".") for w in words[n - 1 : -1])


def test_small_batches_are_counted_together():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * 8] * n, pa.binary())], ["hashes"]) for n in (3, 0, 4, 30, 1)]
    assert [b.num_rows for b in C.chunk_slices(batches, 0, 80)] == [7, 10, 10, 10, 1]


def test_short_pieces_match_plain_counting(spark):
    draw = random.Random(11)
    rows = [(i, draw.choice(["a.csv", None]), "".join(draw.choice(["a", "b", "c"]) + draw.choice([" ", ". ", "..", "\t,"]) for _ in range(150))) for i in range(30)]
    assert result(collocations(frame(spark, rows), least=5)) == plain([(f, t) for _, f, t in rows], 5)
