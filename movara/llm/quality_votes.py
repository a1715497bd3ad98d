"""Quality of uploads by the votes of their nearest labelled neighbours.

Word shapes, words and the byte runs of long words become hashed features, weighted by their frequency over all uploads. A bounded, hashed sample
of reviewed uploads gives a truncated singular value decomposition (latent-semantic axes); its vectors are
broadcast, and every upload takes exact blocked cosine products with all of them. The nearest vote for their labels,
weighted by similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movara.llm.common import hashed_sample, map_content, saved

FEATURES = 4096
#: Reviewed uploads that the model is fitted on, at most.
SAMPLE = 4096
AXES = 48
NEIGHBOURS = 31
#: Labelled vectors multiplied at once.
BLOCK = 1024
#: Votes weigh the cosine to this power.
SHARPNESS = 8
SEED = 7
#: Distinct shapes, and words, whose features a task keeps, and the most bytes of one.
REMEMBERED = 200_000
KEPT_BYTES = 64

#: Bytes of a word's shape: capitals, small letters and non-ASCII, digits; other characters stay.
CLASSES = bytes(
    65 if 65 <= b <= 90 else 97 if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else b for b in range(256)
)
RUNS = re.compile(rb"([Aa0])\1*|(.)\2*", re.DOTALL)
MARKS = bytes(b for b in range(256) if b not in b"Aa0")
#: Words of more bytes also give all their runs of GRAM bytes (two characters of most scripts without blanks).
LONG = 24
GRAM = 6
#: Grams hashed at once.
CHUNK = 65_536


def hashed(kind: str, name: bytes) -> int:
    return crc32(name, crc32(kind.encode())) % FEATURES


def shape_features(classes: bytes) -> tuple[int, int]:
    """Hashed shape of a word, its runs cut to one letter class or two equal marks, and its ending of marks."""
    shape = b"".join(m[1] or m[0][:2] for m in RUNS.finditer(classes))
    return hashed("shape", shape), hashed("ending", classes[len(classes.rstrip(MARKS)) :])


def gram_counts(word: bytes) -> np.ndarray:
    """How often each feature occurs among all byte runs of a long word."""
    codes, counts = np.frombuffer(word, np.uint8).astype(np.uint64), np.zeros(FEATURES, np.int64)
    for at in range(0, len(word) - GRAM + 1, CHUNK):
        part = codes[at : at + CHUNK + GRAM - 1]
        grams = sum(part[k : len(part) - GRAM + 1 + k] << np.uint64(8 * k) for k in range(GRAM))
        places = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(FEATURES)
        counts += np.bincount(places.astype(np.int64), minlength=FEATURES)
    return counts


class Counting:
    """Feature counts of texts; remembers the features of shapes and words."""

    def __init__(self):
        self.shapes: dict[bytes, tuple[int, int]] = {}
        self.words: dict[bytes, int] = {}

    def __call__(self, content: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features and log-scaled counts; one feature for an empty text."""
        content = content or b""
        counts = np.zeros(FEATURES, np.float64)
        for known in (self.shapes, self.words):
            if len(known) > REMEMBERED:
                known.clear()
        places, times = [], []
        for classes, n in Counter(content.translate(CLASSES).split()).items():
            ids = self.shapes.get(classes)
            if ids is None:
                ids = shape_features(classes)
                if len(classes) <= KEPT_BYTES:
                    self.shapes[classes] = ids
            places += ids
            times += (n, n)
        seen = Counter(content.split())
        for word, n in seen.items():
            i = self.words.get(word)
            if i is None:
                i = hashed("word", word.lower())
                if len(word) <= KEPT_BYTES:
                    self.words[word] = i
            places.append(i)
            times.append(n)
            if len(word) > LONG:
                counts += n * gram_counts(word.lower())
        if places:
            counts += np.bincount(places, times, FEATURES)
        total = sum(seen.values())
        variety = int(8 * len(seen) / total) if total else -1
        most = int(8 * max(seen.values()) / total) if total else -1
        for kind, name in (("variety", f"{variety} {min(total, 1000).bit_length()}"), ("most", f"{most}")):
            counts[hashed(kind, name.encode())] += max(1.0, total / 2)
        found = np.flatnonzero(counts)
        return found, np.log1p(counts[found])


def document_frequencies(uploads: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all uploads each feature occurs, and their number; summed on the cluster, a row a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = Counting(), np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for content in batch.column(0):
                held[count(content.as_py())[0]] += 1
                held[FEATURES] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["feature", "n"])

    rows = (
        uploads.select(F.col("content").cast("binary"))
        .mapInArrow(run, "feature long, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    held = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        held[r["feature"]] = r["n"]
    return held[:FEATURES], int(held[FEATURES])


@dataclass
class Votes:
    """Feature weights, latent axes and labelled vectors; what the tasks need to score."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def dense(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        held = np.zeros((len(rows), FEATURES), np.float32)
        for row, (found, counts) in zip(held, rows, strict=True):
            row[found] = counts * self.weights[found]
        return unit(held)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        asked = unit(self.dense(rows) @ self.axes)
        near = np.full((len(rows), 0), 0, np.float32)
        votes = np.zeros((len(rows), 0), np.float32)
        for at in range(0, len(self.labels), BLOCK):
            cosines = asked @ self.vectors[at : at + BLOCK].T
            near = np.concatenate([near, cosines], axis=1)
            votes = np.concatenate([votes, np.broadcast_to(self.labels[at : at + BLOCK], cosines.shape)], axis=1)
            if near.shape[1] > NEIGHBOURS:
                best = np.argpartition(-near, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                near, votes = np.take_along_axis(near, best, 1), np.take_along_axis(votes, best, 1)
        weight = np.clip(near.astype(np.float64), 0, None) ** SHARPNESS
        even = 1e-6  # where nothing is near, the labels' own share decides
        return np.clip(((weight * votes).sum(axis=1) + even * self.labels.mean()) / (weight.sum(axis=1) + even), 0, 1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def latent_axes(matrix: np.ndarray, axes: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a seeded start."""
    start = np.random.default_rng(SEED).standard_normal((matrix.shape[1], axes)).astype(np.float32)
    basis = np.linalg.qr(matrix @ start)[0]
    for _ in range(4):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    return np.linalg.svd(basis.T @ matrix, full_matrices=False)[2].T.astype(np.float32)


def fit_votes(uploads: DataFrame, reviews: DataFrame, sample: int = SAMPLE, axes: int = AXES) -> Votes:
    """``uploads`` (dataset_id, content), ``reviews`` (dataset_id, accepted 0/1) to a model.

    Feature frequencies come from all uploads. At most ``sample`` reviewed uploads, chosen by a hash of their id, give
    the axes and the labelled vectors; only their feature counts reach the driver. Reviews without id or label are
    ignored; of several for one upload the highest counts, of several rows with one id any single one.
    """
    reviewed = (
        reviews.where("dataset_id is not null and accepted is not null")
        .groupBy("dataset_id")
        .agg(F.max("accepted").cast("int").alias("accepted"))
        .join(uploads.select("dataset_id").distinct(), "dataset_id", "left_semi")
    )
    chosen = hashed_sample(saved(reviewed), F.xxhash64("dataset_id"), sample)

    def start():
        count = Counting()

        def step(contents: list) -> dict[str, list]:
            rows = [count(c) for c in contents]
            return {"found": [f.tolist() for f, _ in rows], "counts": [c.tolist() for _, c in rows]}

        return step

    texts = uploads.join(F.broadcast(chosen), "dataset_id").select("dataset_id", "accepted", "content")
    rows = (
        map_content(texts, ("dataset_id", "accepted"), "found array<int>, counts array<double>", start)
        .groupBy("dataset_id", "accepted")
        .agg(F.min(F.struct("found", "counts")).alias("features"))
        .orderBy(F.xxhash64("dataset_id"))
        .collect()
    )
    frequency, total = document_frequencies(uploads)
    weights = np.log((1 + total) / (1 + frequency)) + 1
    model = Votes(weights, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    if rows:
        matrix = model.dense([(np.array(r.features.found, np.int64), np.array(r.features.counts)) for r in rows])
        model.axes = latent_axes(matrix, min(axes, len(rows)))
        model.vectors = unit(matrix @ model.axes)
        model.labels = np.array([r.accepted for r in rows], np.float32)
    return model


def score_uploads(uploads: DataFrame, model: Votes, carry: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The carried columns and ``score``, 0 to 1, higher where accepted is likelier.

    Only the text is used. A missing or empty text has the features of an empty one and is scored like any other; rows are
    scored by themselves, so repeated rows repeat their score. Without reviewed uploads every score is 0.5.
    """
    held = uploads.sparkSession.sparkContext.broadcast(model)

    def start():
        count, votes = Counting(), held.value
        return lambda contents: {"score": votes.score([count(c) for c in contents]).tolist()}

    return map_content(uploads, carry, "score double", start)
