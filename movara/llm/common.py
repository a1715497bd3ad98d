"""Pieces that the text operators share.

The library's record is the upload: ``dataset_id``, ``file_name`` and the whole text of the file,
``content``. Operators read these columns by name and ignore any other, so extra columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from movara.functions.sharing import shared_folder

#: Rows, and bytes of text, turned into Python objects at once; a longer text is a slice of its own.
SLICE, SLICE_BYTES = 256, 8 << 20

#: Bytes of a text after lower-casing A-Z, with every ASCII byte that is no letter or digit made a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: The same words in an original text, for offsets.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(documents: DataFrame) -> DataFrame:
    """The documents table as uploads."""
    return documents.select(
        F.col("doc_id").alias("dataset_id"), F.col("source").alias("file_name"), F.col("text").alias("content")
    )


def with_record(documents: DataFrame) -> DataFrame:
    """Uploads that carry their whole row as ``record``, whatever its columns are called."""
    return documents.select(
        F.col("doc_id").alias("dataset_id"),
        F.col("source").alias("file_name"),
        F.col("text").alias("content"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"),
    )


def saved(df: DataFrame) -> DataFrame:
    """The frame written once to the cluster's checkpoint folder, so that later steps read it there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def hashed_sample(df: DataFrame, place: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest ``place`` (a 64-bit hash of what tells rows apart).

    Only a share of the hash range that holds some times as many rows is ever ordered, so what is compared does
    not grow with the table.
    """
    total = df.count()
    share = min(1.0, 4 * rows / max(total, 1))
    edge = int(-(2**63) + share * (2**64 - 1))
    marked = df.withColumn("__place", place)
    near = marked.where(F.col("__place") <= min(edge, 2**63 - 1)) if share < 1 else marked
    return near.orderBy("__place", *df.columns).limit(rows).drop("__place")


def words(content: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for a missing text."""
    return content.translate(WORD_BYTES).split() if content else []


def text_slices(sizes: list, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are bounded in number and bytes; ``sizes`` may have nulls."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or held + (size or 0) > SLICE_BYTES):
            yield start, i
            start, held = i, 0
        held += size or 0
    if sizes:
        yield start, len(sizes)


def map_content(
    df: DataFrame,
    carry: Sequence[str],
    fields: str,
    start: Callable[[], Callable[[list], dict[str, list]]],
    rows: int = SLICE,
) -> DataFrame:
    """Append columns computed from ``content``, row by row inside tasks.

    ``start`` runs once a task and returns a function from a list of UTF-8 texts (``None`` where
    missing; ``rows`` at a time, or fewer long ones) to the new columns; ``fields`` is their schema. Only ``carry`` is kept.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[c] for c in carry] + added.fields)
    names = [f.name for f in added]
    types = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at, end in text_slices(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist(), rows):
                part = batch.slice(at, end - at)
                made = step(part.column(part.num_columns - 1).to_pylist())
                arrays = [part.column(i) for i in range(len(carry))] + [pa.array(made[n], types[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, *names])

    source = df.select(*[F.col(c) for c in carry], F.col("content").cast("binary").alias("__content"))
    return source.mapInArrow(run, schema)
