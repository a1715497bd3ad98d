"""Phrases that belong together, counted over a prefix-free parse of the texts.

Texts are cut into chunks at pairs of words that a hash picks, so equal passages give equal chunks wherever they stand. A chunk
runs over ends of pieces, which it marks, and also sees the first words of the next one while the piece lasts; a phrase belongs to
the chunk in which it starts, so every occurrence is counted once. Distinct chunks are a dictionary with frequencies: phrases are
counted inside the dictionary, weighted by frequency, so a long passage that a third of all files repeat is read once.

Phrases are counted from short to long. A phrase can only be frequent if all its parts are, so each round leaves out what the
rounds before have ruled out. Rounds count 64-bit hashes, which can only raise a count; the last round counts the phrases
that are left as texts, exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.functions.sharing import written

#: Words of the longest phrase; a chunk sees one less of the next chunk's words.
LONGEST = 4
#: One pair of words in so many starts a chunk; no chunk has more own words than the most.
EVERY, MOST = 32, 64
#: Bytes of text turned into words at once.
SLICE_BYTES = 1 << 22
#: Bytes of hashes, four a word, whose phrases are counted at once: the more, the fewer times a phrase leaves a task.
HASH_BYTES = 1 << 21
#: Bits of the table that tells ruled-out hashes, a power of two: 8 MB. More frequent phrases than bits only rule out less.
TABLE_BITS = 26
SEED = 42

#: A-Z lower-cased, tabs as blanks, every character that ends a piece as a full stop.
PIECES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256)
)
STOP = re.compile(rb"[.,;:!?\n-\r]")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def coded(line: bytes) -> tuple[np.ndarray, pa.Array]:
    """Each token's number among the distinct ones; every token ends with a blank, which its name leaves out."""
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1
    offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
    found = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(line)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.binary_slice(found.dictionary, 0, -1)


def portions(texts: list, groups: list) -> Iterator[tuple[bytes, object]]:
    """Texts with their groups; one of more bytes than a slice falls into several at ends of pieces."""
    for text, group in zip(texts, groups, strict=True):
        at, text = 0, text or b""
        while len(text) - at > SLICE_BYTES and (cut := STOP.search(text, at + SLICE_BYTES // 2)):
            yield text[at : cut.start()], group
            at = cut.end()
        yield text[at:], group


def slices(sizes: list[int], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded bytes (``SLICE_BYTES`` if not given); a longer text is a range of its own."""
    start, held, most = 0, 0, most or SLICE_BYTES
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def chunks_of(texts: list[bytes | None], groups: list) -> Counter:
    """(group, own words, chunk) of the texts, with how often each occurs. A full stop follows a word that ends a piece."""
    # no translated text holds an exclamation mark: it ends a text
    texts = [(t or b"").translate(PIECES).replace(b".", b" . ") for t in texts]
    codes, names = coded(b" ! ".join(texts) + b" . ! ")
    blank, full_stop, text_end = (pc.index(names, pa.scalar(token, pa.binary())).as_py() for token in (b"", b".", b"!"))
    codes = codes[codes != blank]
    text_ends = codes == text_end
    stop = text_ends | (codes == full_stop)
    words = np.flatnonzero(~stop)
    if not len(words):
        return Counter()
    of = np.cumsum(text_ends)[words]
    last = stop[words + 1]
    codes = codes[words]
    hashes = word_hashes(listed(names))[codes]
    picked = np.ones(len(words), bool)
    picked[1:] = (mixed(hashes[1:] * MIX[0] + hashes[:-1]) % np.uint64(EVERY) == 0) | (of[1:] != of[:-1])
    starts = np.flatnonzero(picked)
    runs = np.diff(np.append(starts, len(words)))
    # long runs without a picked pair
    parts = -(-runs // MOST)
    begun = MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    at = np.repeat(starts, parts) + begun
    own = np.minimum(np.repeat(runs, parts) - begun, MOST)
    ends_of_pieces = np.flatnonzero(last)
    piece_end = ends_of_pieces[np.searchsorted(ends_of_pieces, at + own - 1)]
    seen = np.minimum(at + own + LONGEST - 2, piece_end)
    # all words in a row, each with a blank or a full stop and a blank; a chunk ends with its last word
    followed = [pc.binary_join_element_wise(names, pa.scalar(mark, pa.binary()), pa.scalar(b"", pa.binary())) for mark in (b" ", b". ")]
    line = pa.concat_arrays(followed).take(pa.array(codes + len(names) * last))
    offsets = np.frombuffer(line.buffers()[1], np.int32, len(words) + 1)
    ends = offsets[seen + 1] - 1 - last[seen]
    text = line.buffers()[2].to_pybytes()
    return Counter((groups[t], n, text[a:b]) for t, n, a, b in zip(of[at].tolist(), own.tolist(), offsets[at].tolist(), ends.tolist()))


def words_of(chunks: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the chunks' words, the distinct words, and which words of the chunks end a piece."""
    line = b" ".join(listed(chunks)) + b" "
    held = np.frombuffer(line, np.uint8)
    last = held[np.flatnonzero(held == 32) - 1] == 46
    return *coded(line.replace(b". ", b" ")), last


def dictionary(uploads: DataFrame, by: str) -> DataFrame:
    """Distinct chunks: ``by``, ``own`` (words that start a phrase here), ``chunk``, ``times`` and ``hashes``.

    A word has 32 bits of ``hashes``, the lowest one set where it ends a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, groups = zip(*portions(batch.column(1).to_pylist(), batch.column(0).to_pylist())) if batch.num_rows else ((), ())
            for start, end in slices([len(t) for t in texts]):
                found = chunks_of(list(texts[start:end]), groups[start:end])
                if found:
                    by_, own, chunk = zip(*found)
                    arrays = [pa.array(by_, pa.string()), pa.array(own, pa.int32()), pa.array(chunk, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(found.values()), pa.int64())], ["by", "own", "chunk", "times"])

    read = uploads.select(F.col(by).alias("by"), F.col("content").cast("binary").alias("content"))
    found = read.mapInArrow(run, "by string, own int, chunk binary, times long")
    distinct = found.groupBy("by", "own", "chunk").agg(F.sum("times").alias("times"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunk_slices(batches, 2, SLICE_BYTES):
            codes, names, last = words_of(part.column(2))
            hashes = (word_hashes(listed(names)) >> np.uint64(33)).astype(np.uint32)[codes] << np.uint32(1) | last
            ends = np.cumsum(pc.add(pc.count_substring(part.column(2), " "), 1).to_numpy()) * 4
            offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(hashes)])
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "hashes"])

    return written(distinct.mapInArrow(hashed, "by string, own int, chunk binary, times long, hashes binary"), "phrase-chunks")


def chunk_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of one batch or several together, of bounded bytes in the column."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(column))
        for start, end in slices(listed(sizes), most):
            part, more = batch.slice(start, end - start), pc.sum(sizes[start:end]).as_py()
            if held and size + more > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.concat_batches(held)


class Words:
    """The words of some chunks (``by``, ``own``, ``times``, ``hashes``) as arrays: hashes, own starts, groups, weights."""

    def __init__(self, part: pa.RecordBatch):
        hashes = part.column(3)
        sizes = pc.binary_length(hashes).to_numpy() // 4
        ends = np.cumsum(sizes)
        found = np.frombuffer(b"".join(listed(hashes)), np.uint32)
        self.hashes = (found >> np.uint32(1)).astype(np.uint64) * MIX[1]
        self.last = found & np.uint32(1) > 0
        self.last[ends - 1] = True
        self.chunk = np.repeat(np.arange(len(sizes)), sizes)
        own = ends - sizes + part.column(1).to_numpy()
        self.starts = np.arange(len(found)) < own[self.chunk]
        self.times = part.column(2).to_numpy()[self.chunk]
        found = part.column(0).dictionary_encode()
        self.groups = [*found.dictionary.to_pylist(), None]
        self.group = found.indices.fill_null(len(self.groups) - 1).to_numpy(zero_copy_only=False).astype(np.int64)[self.chunk]
        salts = [xxhash.xxh64_intdigest(g or b"", seed=SEED + 1 + (g is None)) for g in self.groups]
        self.salt = np.array(salts, np.uint64)[self.group]

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two …: where a phrase of so many fits, and every place's hash as if one did."""
        fits, hashes = np.ones(len(self.hashes), bool), mixed(self.hashes + self.salt)
        yield fits, hashes
        for k in range(1, longest):
            fits = fits.copy()
            fits[-k:] = False
            fits[:-k] &= ~self.last[k - 1 : -1]
            following = np.zeros_like(hashes)
            following[:-k] = self.hashes[k:]
            hashes = mixed(hashes * MIX[0] + following)
            yield fits, hashes


def place(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = hashes >> np.uint64(64 - TABLE_BITS)
    return (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8)


def held_by(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, bit = place(hashes)
    return table[at] & bit > 0


def table_of(hashes: DataFrame) -> np.ndarray:
    """One bit for each hash of a phrase that may be frequent, set in tasks and merged piece by piece; its size is fixed."""

    def made(piece: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for batch in batches:
            at, bit = place(batch.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, at, bit)
        yield from (made(piece, own) for piece, own in enumerate(bits.reshape(128, -1)) if own.any())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, bits = None, None
        for batch in batches:
            for number, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(own, np.uint8)
                if number != piece and piece is not None:
                    yield made(piece, bits)
                piece, bits = number, bits | own if number == piece else own
        if piece is not None:
            yield made(piece, bits)

    parts = hashes.mapInArrow(run, "piece int, bits binary").repartition("piece").sortWithinPartitions("piece")
    table = np.zeros((128, 1 << (TABLE_BITS - 10)), np.uint8)
    for row in parts.mapInArrow(merge, "piece int, bits binary").collect():
        table[row.piece] = np.frombuffer(row.bits, np.uint8)
    return table.reshape(-1)


def shifted(flags: np.ndarray) -> np.ndarray:
    return np.append(flags[1:], False)


def open_phrases(words: Words, tables: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, hashes) of the phrases up to ``longest`` that no table rules out; the last table also has longer phrases."""
    fits = None
    for n, (enough, hashes) in enumerate(words.phrases(longest), 1):
        fits = enough if fits is None else fits & shifted(fits) & enough
        if tables and (n <= len(tables) or len(tables) == LONGEST - 1):
            fits = fits & held_by(tables[min(n, len(tables)) - 1], hashes)
        yield n, fits, hashes


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each with the sum of its times and one of its places."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times, order[first]


def counted_hashes(chunks: DataFrame, tables: list[np.ndarray], longest: int, least: int) -> DataFrame:
    """Hashes of phrases of len(tables) + 1 to ``longest`` words that occur ``least`` times or more, collisions included."""
    held = chunks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunk_slices(batches, 3, HASH_BYTES):
            words = Words(part)
            for n, fits, hashes in open_phrases(words, held.value, longest):
                if n > len(held.value):
                    own = fits & words.starts
                    keys, times, _ = summed(hashes[own], words.times[own])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["key", "times"])

    found = chunks.select("by", "own", "times", "hashes").mapInArrow(run, "key long, times long")
    return found.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("key")


def phrase_numbers(group: np.ndarray, groups: int, codes: list[np.ndarray], names: int) -> np.ndarray:
    """One number a phrase, equal only for the same words in the same group."""
    number, bound = group, groups
    for code in codes:
        if bound * names >= 1 << 63:  # the next word would not fit: the numbers so far are made dense
            distinct, number = np.unique(number, return_inverse=True)
            bound = len(distinct)
        number, bound = number * names + code, bound * names
    return number


def phrase_texts(names: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    """Phrases as texts, from the numbers of their first, second … words."""
    return pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in codes], pa.scalar(b" ", pa.binary()))


def counted_phrases(chunks: DataFrame, tables: list[np.ndarray], least: int) -> DataFrame:
    """Phrases (``by``, ``words``, ``phrase``, ``times``) that occur ``least`` times or more, told apart word by word."""
    held = chunks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunk_slices(batches, 3, HASH_BYTES):
            words = Words(part)
            codes, names, _ = words_of(part.column(4))
            groups = pa.array(words.groups, pa.string())
            for n, fits, _ in open_phrases(words, held.value, LONGEST):
                own = np.flatnonzero(fits & words.starts)
                code = phrase_numbers(words.group[own], len(words.groups), [codes[own + k] for k in range(n)], len(names))
                _, times, first = summed(code, words.times[own])
                at = own[first]
                arrays = [
                    groups.take(pa.array(words.group[at])),
                    pa.array(np.full(len(at), n), pa.int32()),
                    phrase_texts(names, [codes[at + k] for k in range(n)]),
                    pa.array(times),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["by", "words", "phrase", "times"])

    found = chunks.select("by", "own", "times", "hashes", "chunk").mapInArrow(run, "by string, words int, phrase binary, times long")
    return found.groupBy("by", "words", "phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= least)


def phrase_counts(chunks: DataFrame, least: int) -> DataFrame:
    """All phrases of one to four words (``by``, ``words``, ``phrase``, ``times``) that occur ``least`` times or more."""
    tables = []
    for longest in (1, 2, LONGEST):
        tables.append(table_of(counted_hashes(chunks, tables, longest, least)))
    counts = counted_phrases(chunks, tables, least)
    return written(counts.withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def whole(value: int | Column) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(19,0)")


def collocations(uploads: DataFrame, by: str = "file_name", least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """The phrases of two to four words that hold together best, in each group of uploads.

    ``uploads``: ``content`` and the column ``by`` (string), whose values are groups; others are ignored. A text falls into pieces
    at ``.,;:!?`` and line ends, a piece into words at blanks and tabs; A-Z are lower-cased; a missing text has none. A phrase
    that occurs ``least`` times or more (a) is cut in two where l + r, the occurrences of its two parts, makes
    floor(2,000,000 a / (l + r)) smallest, the first such place. Phrases inside a longer frequent one with at least
    ``covered`` per cent of their occurrences are left out.

    Returns ``by``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the group) and ``score``: the first ``most`` a group
    by score, a (both falling) and phrase (by bytes). Rows without group share the group null; an empty table, or
    a group without a frequent phrase, gives none. Repeated rows count as often as they stand.
    """
    chunks = dictionary(uploads, by)
    totals = chunks.groupBy("by").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    counts = phrase_counts(chunks, least)
    candidates = counts.where("words > 1")
    group = F.coalesce(F.concat(F.lit("="), "by"), F.lit(""))  # null is a group too
    known = counts.select(group.alias("__group"), F.col("phrase").alias("__phrase"), F.col("times").alias("__times"))

    words = F.split("phrase", " ")
    join = lambda start, length: F.array_join(F.slice("__words", start, length), " ")
    cuts = candidates.select(group.alias("__group"), "phrase", "words", F.col("times").alias("a"), words.alias("__words")).select(
        "__group", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "__words"
    )
    cuts = cuts.withColumns({"first": join(F.lit(1), F.col("k")), "rest": join(F.col("k") + 1, F.col("words") - F.col("k"))}).drop("__words")
    for side, part in (("l", "first"), ("r", "rest")):
        named = known.select("__group", F.col("__phrase").alias(part), F.col("__times").alias(side))
        cuts = attached(cuts, named, ["__group", part], F.col("phrase"))
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cut = F.struct(score.alias("score"), "k", "l", "r")
    scored = cuts.groupBy("__group", "phrase", "a").agg(F.min(cut).alias("cut"))

    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda length: F.transform(
                    F.sequence(F.lit(1), F.col("words") - length + 1), lambda start: F.array_join(F.slice(F.col("__words"), start, length), " ")
                ),
            )
        )
    )
    longer = candidates.where("words > 2").select(group.alias("__group"), "words", F.col("times"), words.alias("__words"))
    cover = longer.select("__group", "times", inner.alias("phrase")).groupBy("__group", "phrase").agg(F.max("times").alias("__cover"))
    free = F.col("__cover").isNull() | (whole(100) * whole(F.col("__cover")) < whole(covered) * whole(F.col("a")))
    kept = scored.join(cover, ["__group", "phrase"], "left").where(free)
    order = Window.partitionBy("__group").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    sized = totals.select(group.alias("__group"), F.col("by").alias(by), "n")
    return ranked.join(sized, "__group").select(
        by, F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
