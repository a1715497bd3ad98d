"""Personal data in uploads: certain patterns, and what a character LSTM with CRF transitions finds besides.

The model is trained in numpy on labelled spans: written samples of each kind, set into excerpts of the uploads
themselves. Every text is cut into overlapping windows and all are decoded. What neighbouring windows find in their common part is
reconciled over the whole text: a span counts as the window saw it in which it lies farthest from the cuts, and pieces that run over
cuts are joined.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.llm.common import hashed_sample, map_content
from movara.llm.tagger import Tagger, codes, train

KINDS = ("email", "ip", "card", "phone")
#: Window, and what neighbours share of it: more than twice the longest item (39 characters), so that one of them sees it with its surroundings.
WINDOW, OVERLAP = 512, 96
#: Windows run together.
AT_ONCE = 1024
#: Excerpts that the training takes from the uploads, and their characters, at most.
EXCERPTS, EXCERPT = 200, 2000
TRAINED, LENGTH, HELD_OUT = 3000, 96, 400
HIDDEN, ROUNDS, BATCH, RATE, SEED = 8, 14, 100, 0.03, 11

#: The certain patterns; addresses are searched from their @ (see ``emails``).
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(content: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and a domain, found from each @ so that long runs cost once."""
    done, at = 0, content.find(b"@")
    while at >= 0:
        start = at
        while start > done and content[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(content, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = content.find(b"@", done)


def luhn(digits: bytes) -> bool:
    numbers = [d - 48 for d in reversed(digits)]
    return (sum(numbers[::2]) + sum(n * 2 - 9 * (n > 4) for n in numbers[1::2])) % 10 == 0


def digits(text: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", text)


def certain_spans(content: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the certain patterns, by bytes, in order; the patterns hold ASCII only."""
    found = [(a, 0, b) for a, b in emails(content)] if b"@" in content else []
    if re.search(rb"[0-9]", content) is None:
        return found
    for m in IP.finditer(content):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (q.lstrip(b"0") for q in m[0].split(b"."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(content):
        number = digits(m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(content):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- training samples ---------------------------------------------------------------------------------------------


def written_sample(kind: int, rng: np.random.Generator) -> str:
    """One invented item of a kind, in one of the ways people write it."""
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), n))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: str(rng.choice(options))
    if kind == 0:
        user = pick(letters(rng.integers(3, 9)), f"{letters(4)}.{letters(6)}", f"{letters(5)}{number(2)}")
        host, end = letters(rng.integers(4, 9)), pick("com", "org", "net", "de")
        at, dot = pick("@.", "@.", " at | dot ", " [at] | [dot] ", "(at)|.", " (at) | (dot) ").replace("@.", "@|.").split("|")
        return f"{user}{at}{host}{dot}{end}"
    if kind == 1:
        if rng.random() < 0.5:
            return ".".join(str(rng.integers(1, 256)) for _ in range(4))
        parts = [f"{rng.integers(1, 65536):x}" for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:3]) + "::" + ":".join(parts[5:])
    if kind == 2:
        if rng.random() < 0.4:
            stem = number(15)
            card = next(stem + c for c in "0123456789" if luhn((stem + c).encode()))
            return card if rng.random() < 0.5 else " ".join(card[i : i + 4] for i in range(0, 16, 4))
        body = number(18)
        iban = f"DE{98 - int(body + '131400') % 97:02d}{body}"
        return iban if rng.random() < 0.5 else " ".join(iban[i : i + 4] for i in range(0, 22, 4))
    return pick(
        f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}",
        f"00{number(2)} {number(3)} {number(7)}", f"0{number(3)}/{number(6)}", f"{number(3)}.{number(3)}.{number(4)}",
    )


def harmless_sample(rng: np.random.Generator) -> str:
    """Something with figures or marks that is no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    return str(
        rng.choice(
            [
                f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 24)}:{n(0, 60):02d}", f"{n(1, 999)}.{n(100, 999)},{n(10, 99)}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}",
                f"#{n(1, 99999)}", f"{n(1, 100)} %", f"p. {n(1, 500)}", f"{rng.integers(0, 2**62):x}", f"{n(1, 10**6)}", f"R$ {n(1, 999)},{n(10, 99)}", "look at the dot on it",
                f"{n(10**15, 9 * 10**15)}", f"token = \"{rng.integers(0, 2**62):x}\"", "a@b", f"{n(1, 9)}/{n(1, 9)}", "***", "&&& %%% ###",
            ]
        )
    )


def labelled_windows(excerpts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Code windows and their tags: excerpts with samples set in; certain spans of the excerpts are tagged too."""
    windows, tags = np.full((count, LENGTH), 32, np.uint8), np.zeros((count, LENGTH), np.int64)
    excerpts = excerpts or [" "]
    for row in range(count):
        text, marks = "", []
        while len(text) < LENGTH:
            source = excerpts[rng.integers(len(excerpts))]
            at = int(rng.integers(0, max(1, len(source) - 60)))
            text += source[at : at + int(rng.integers(10, 60))] + str(rng.choice([" ", " ", "\n", ", ", ": ", " ("]))
            draw = rng.random()
            if draw < 0.45:
                kind = int(rng.integers(4))
                sample = written_sample(kind, rng)
                marks.append((len(text), kind, len(text) + len(sample)))
                text += sample + str(rng.choice([" ", ".", ", ", "\n", ")"]))
            elif draw < 0.75:
                text += harmless_sample(rng) + " "
        plain = codes(text)
        own = np.zeros(len(plain), np.int64)
        for start, kind, end in [*certain_spans(plain.tobytes()), *marks]:
            own[start:end] = kind + 1
        shift = int(rng.integers(0, len(plain) - LENGTH + 1))
        windows[row], tags[row] = plain[shift : shift + LENGTH], own[shift : shift + LENGTH]
    return windows, tags


def excerpts_of(uploads: DataFrame) -> list[str]:
    """A bounded, hashed sample of excerpts, the same for the same uploads."""
    place = F.xxhash64("dataset_id", "content")
    room = F.greatest(F.length("content") - EXCERPT, F.lit(0)) + 1
    excerpt = F.substring(F.col("content"), F.pmod(place, room).cast("int") + 1, F.lit(EXCERPT))
    rows = hashed_sample(
        uploads.where("content is not null and content <> ''").select(place.alias("place"), excerpt.alias("excerpt")),
        F.col("place"),
        EXCERPTS,
    ).collect()
    return [r["excerpt"] for r in rows]


def train_model(excerpts: list[str], trained: int = TRAINED) -> Tagger:
    windows, tags = labelled_windows(excerpts, trained, np.random.default_rng(SEED))
    return train(windows, tags, len(KINDS) + 1, HIDDEN, ROUNDS, BATCH, RATE, SEED)


def held_out_accuracy(model: Tagger, excerpts: list[str]) -> dict[str, float]:
    """Share of right tags, and precision and recall of tagged characters, on windows that training did not see."""
    windows, tags = labelled_windows(excerpts, HELD_OUT, np.random.default_rng(SEED + 1))
    given = np.zeros_like(tags)
    for row, path in model.decode(np.ascontiguousarray(windows.T)).items():
        given[row] = path
    hit = ((given == tags) & (tags > 0)).sum()
    return {"right": float((given == tags).mean()), "precision": float(hit / max(1, (given > 0).sum())), "recall": float(hit / max(1, (tags > 0).sum()))}


# --- decoding -----------------------------------------------------------------------------------------------------


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one tag as (start, kind number, end)."""
    cuts = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
    return [(int(a), int(tags[a]) - 1, int(b)) for a, b in zip(cuts, cuts[1:]) if tags[a]]


def reconciled(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a text from what its windows found, in the windows' order: (start, kind, end, window's start, window's end).

    The ends of the text are no cuts. Pieces that reach a cut and go on in the next window are one span. Of spans that overlap the one
    farther from the cuts of its window stays.
    """
    whole: list[list] = []
    for start, kind, end, low, high in pieces:
        last = next((w for w in reversed(whole) if w[1] == kind and w[2] == w[4] and start == low and w[0] <= start <= w[2]), None)
        if last:
            last[2:] = end, last[3], high
        else:
            whole.append([start, kind, end, low, high])
    kept: list[tuple[int, int, int]] = []
    for start, kind, end, low, high in sorted(whole, key=lambda w: (-min(w[0] - w[3], w[4] - w[2]), w[0])):
        if not any(a < end and start < b for a, _, b in kept):
            kept.append((start, kind, end))
    return sorted(kept)


def text_spans(model: Tagger, texts: list[np.ndarray], window: int = WINDOW, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """The spans that the model finds in every text: (start, kind number, end)."""
    stride = window - overlap
    counts = [max(1, -(-(len(t) - overlap) // stride)) if len(t) else 0 for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if counts else np.zeros(0, np.int64)
    held = []
    for text, n in zip(texts, counts, strict=True):
        if n:
            padded = np.full(n * stride + overlap, 10, np.uint8)
            padded[: len(text)] = text
            held.append(sliding_window_view(padded, window)[::stride])
    pieces: dict[int, list] = {}
    far = 1 << 40
    windows = np.concatenate(held) if held else np.zeros((0, window), np.uint8)
    for at in range(0, len(windows), AT_ONCE):
        for place, path in sorted(model.decode(np.ascontiguousarray(windows[at : at + AT_ONCE].T)).items()):
            number = int(owner[at + place])
            turn, size = int(at + place - first[number]), len(texts[number])
            start = turn * stride
            low = start if turn else -far
            high = start + window if turn < counts[number] - 1 else far
            for a, kind, b in tagged_spans(path[: max(0, size - start)]):
                pieces.setdefault(number, []).append((start + a, kind, start + b, low, high))
    return [reconciled(pieces.get(i, [])) for i in range(len(texts))]


WRITTEN_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+ ?(?:\.| ?\(dot\)| ?\[dot\]|dot ) ?[A-Za-z]{2,}"
)


def plausible(kind: int, text: str) -> bool:
    """What a found span must satisfy beside the model's opinion: form, count of digits or check digits."""
    figures = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        return WRITTEN_EMAIL.fullmatch(text) is not None
    if kind == 1:
        try:
            return ipaddress.ip_address(text).version == 6 and text.count(":") > 2
        except ValueError:
            return False
    if kind == 2:
        plain = text.replace(" ", "").upper()
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain) is None:
            return False
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return 9 <= len(figures) <= 15 and re.fullmatch(r"(?:\(?0|\(?[0-9]{3}\)?[ .-])[0-9 ()/.-]+[0-9]", text) is not None


def added_spans(spans: list[tuple[int, int, int]], text: str, certain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans, without their outer blanks and marks, that are plausible and touch no certain span."""
    found = []
    for start, kind, end in spans:
        inner = text[start:end]
        start += len(inner) - len(inner.lstrip(" \t\n.,;:)"))
        end -= len(inner) - len(inner.rstrip(" \t\n.,;:("))
        if plausible(kind, text[start:end]) and not any(a < end and start < b for a, _, b in certain):
            found.append((start, kind, end))
    return found


def scan_personal_data(
    uploads: DataFrame, model: Tagger | None = None, carry: tuple[str, ...] = ("dataset_id",)
) -> DataFrame:
    """Personal data in every upload.

    ``uploads``: ``dataset_id``, ``content`` and the ``carry`` columns. Without a ``model`` one is trained on excerpts of the
    uploads. Returns the carried columns, ``certain`` and ``likely``: spans (``start``, ``kind``, ``end``) in order, by
    code points of the whole text, end exclusive; ``kind`` is an index of ``KINDS``.

    A missing or empty text has no spans; rows are scanned by themselves, so repeated rows repeat their spans. With no
    text at all the model is trained on the written samples alone.
    """
    held = uploads.sparkSession.sparkContext.broadcast(model or train_model(excerpts_of(uploads)))

    def start():
        tagger = held.value
        span = lambda s: {"start": s[0], "kind": s[1], "end": s[2]}

        def step(contents: list) -> dict[str, list]:
            contents = [c or b"" for c in contents]
            texts = [c.decode("utf-8", "replace") for c in contents]
            made = {"certain": [], "likely": []}
            for content, text, spans in zip(contents, texts, text_spans(tagger, [codes(t) for t in texts]), strict=True):
                certain = certain_spans(content)
                if certain and len(content) != len(text):  # bytes to characters
                    points = np.cumsum((np.frombuffer(content, np.uint8) & 0xC0) != 0x80)
                    certain = [(int(points[a]) - 1, k, int(points[b - 1])) for a, k, b in certain]
                made["certain"].append([span(s) for s in certain])
                made["likely"].append([span(s) for s in added_spans(spans, text, certain)])
            return made

        return step

    fields = ", ".join(f"{n} array<struct<start: long, kind: int, end: long>>" for n in ("certain", "likely"))
    return map_content(uploads, carry, fields, start, rows=1024)
