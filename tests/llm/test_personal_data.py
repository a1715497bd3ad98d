"""Personal data: certain spans by plain search, the model by gradients and held-out accuracy."""

import re

import numpy as np
import pytest

from movara.llm import personal_data as module
from movara.llm.personal_data import certain_spans, KINDS, scan_personal_data, text_spans, train_model
from movara.llm.tagger import Tagger, codes

from tests.llm.plain import frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
TEXTS = [
    "é write to a.b@c.example.com, x@@y.org a@b.c@d.e.f @x.y a@b",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 or 001.002.003.004",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 🙂 79927398713 and 123456789012345678901234567890",
    "call +1 (017) 555-7713 or +1 2 or +49 (0)171.123-45 67 89 01 23 45",
    "a" * 70_000 + "@" + "b" * 70_000 + ".c",
    "9" * 5000,
    "",
]


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)] if len(text) < 10_000 else []
    if len(text) > 10_000 and "@" in text:
        found = [(0, 0, len(text))]  # the pattern itself would try every start
    for kind, pattern, keep in (
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if keep(m[0])]
    return sorted(found)


@pytest.fixture(scope="module")
def excerpts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(100).collect()
    return [r.text[:2000] for r in rows]


@pytest.fixture(scope="module")
def model(excerpts):
    return train_model(excerpts)


def test_certain_spans(spark, model):
    rows = [(i, "f", t) for i, t in enumerate(TEXTS)] + [(98, "f", None)]
    got = {r.dataset_id: [tuple(s) for s in r.certain] for r in scan_personal_data(frame(spark, rows), model).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == plain(text), i
    assert got[98] == []


def test_real_documents(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    uploads = documents.selectExpr("doc_id AS dataset_id", "text AS content")
    rows = scan_personal_data(uploads, model, carry=("dataset_id", "content")).collect()
    assert all([tuple(s) for s in r.certain] == plain(r.content) for r in rows)
    assert sum(bool(r.likely) for r in rows) <= 3  # what is written there is certain already


def test_gradients():
    rng = np.random.default_rng(1)
    tagger = Tagger.fresh(4, 3, 2)
    tagger.values = {k: v.astype(np.float64) for k, v in tagger.values.items()}
    windows, tags = rng.integers(97, 104, (9, 6)).astype(np.uint8), rng.integers(0, 3, (9, 6))
    for name, slope in tagger.loss(windows, tags)[1].items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        held, ends = tagger.values[name][at], []
        for step in (1e-5, -1e-5):
            tagger.values[name][at] = held + step
            ends.append(tagger.loss(windows, tags)[0])
        tagger.values[name][at] = held
        assert abs((ends[0] - ends[1]) / 2e-5 - slope[at]) < 1e-6


def test_held_out_accuracy(model, excerpts):
    figures = module.held_out_accuracy(model, excerpts)
    assert figures["right"] > 0.97 and figures["precision"] > 0.92 and figures["recall"] > 0.92


def test_decoding_is_the_best_path(model, excerpts):
    windows, _ = module.labelled_windows(excerpts, 200, np.random.default_rng(3))
    windows = np.ascontiguousarray(windows.T)
    scores, moves = model.emissions(windows).transpose(0, 2, 1).astype(np.float64), model.values["moves"]
    best, came = scores[0], []
    for t in range(1, len(scores)):
        paths = best[:, :, None] + moves
        came.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[t]
    want = [best.argmax(axis=1)]
    for back in reversed(came):
        want.append(back[np.arange(windows.shape[1]), want[-1]])
    got = np.zeros(windows.shape, np.int64)
    for w, path in model.decode(windows).items():
        got[:, w] = path
    assert (got == np.array(want[::-1])).all()


def found_share(model, kind, start, samples):
    """Share of written samples of a kind that are found when they begin at ``start`` of a text."""
    rng = np.random.default_rng(77)
    items = [i for i in (module.written_sample(kind, rng) for _ in range(400)) if module.plausible(kind, i)][:samples]
    texts = [("word and " * 90)[:start] + item + " " + "word and " * 60 for item in items]
    found = text_spans(model, [codes(t) for t in texts])
    hits = 0
    for item, text, spans in zip(items, texts, found, strict=True):
        hits += any(k == kind and a <= start and b >= start + len(item) for a, k, b in module.added_spans(spans, text, []))
    return hits / len(items)


@pytest.mark.parametrize("kind", range(4))
def test_windows_agree_wherever_they_fall(model, kind):
    """Recall across the cuts is what it is in the middle of a window."""
    stride = module.WINDOW - module.OVERLAP
    middle = found_share(model, kind, 9 * 22, 40)
    assert middle >= 0.5
    for start in range(9 * ((stride - 50) // 9), module.WINDOW + 20, 9):  # always after a whole word
        assert found_share(model, kind, start, 40) >= middle - 0.051, start  # two of forty


def test_reconciled_spans():
    far = 1 << 40
    whole = lambda *pieces: module.reconciled(list(pieces))
    assert whole((10, 1, 20, -far, 512), (450, 2, 480, -far, 512), (452, 2, 480, 416, far)) == [(10, 1, 20), (452, 2, 480)]
    assert whole((430, 0, 512, -far, 512), (430, 0, 700, 416, far)) == [(430, 0, 700)]
    # longer than what windows share: joined over two cuts
    assert whole((300, 0, 512, -far, 512), (416, 0, 928, 416, 928), (832, 0, 900, 832, far)) == [(300, 0, 900)]
    assert whole() == []


def test_added_spans_need_their_form():
    assert module.plausible(2, "DE89 3704 0044 0532 0130 00") and not module.plausible(2, "DE88 3704 0044 0532 0130 00")
    assert module.plausible(0, "bob (at) example (dot) org") and not module.plausible(0, "look at the dot")
    assert module.plausible(1, "2001:db8::8a2e:370:7334") and not module.plausible(1, "12:30")
    assert module.plausible(3, "(017) 555-7713") and not module.plausible(3, "2024-01-05")


def test_awkward_rows(spark):
    rows = scan_personal_data(frame(spark)).collect()
    assert len(rows) == 9
    assert scan_personal_data(frame(spark, [])).count() == 0


def test_long_runs_of_zeros():
    zeros = b"0" * 5000
    for text, found in ((zeros + b".1.1.1", 1), (b"1.2." + zeros + b"300.4", 0), (zeros + b"." + zeros + b".0.255", 1)):
        assert len([s for s in certain_spans(text) if s[1] == 1]) == found
