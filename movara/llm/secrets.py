"""Secret scans with linked credential parts, in column expressions only.

Certain patterns are always reported. Weak parts (an identifier, a secret-like value, an endpoint) are common in harmless
files, so one is reported only where its complement lies in the same block of lines or near it: an interval join of the parts of a
file, done as one sweep over them in order and one back. Everything stays in the upload's row, so no group
is gathered and nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movara.functions.columns import let

#: The certain patterns, by kind, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE = 6

#: The weak parts.
IDENTIFIER = (
    r"""(?i)(?<![A-Za-z0-9_])(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|account[_-]?id|user(?:[_-]?(?:name|id))?|login)["']?"""
    r"""\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
)
WEAK_SECRET = (
    r"""(?i)(?<![A-Za-z0-9_])(?:pwd|pass|key|auth|credential|private[_-]?key|access[_-]?key|client[_-]?key)["']?"""
    r"""\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
)
ENDPOINT = (
    r"""(?i)(?<![A-Za-z0-9_])(?:(?:https?|ftp|s3|redis|amqps?|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z]+)://[^\s"'<>,;]+"""
    r"""|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"""
)

KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: What each kind is when parts are linked.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
#: A weak part is reported with any of these near it.
COMPLEMENTS = {"identifier": ("secret",), "weak_secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
#: Parts belong together within one block, a stretch of text without a blank line, and within so many characters anywhere.
SCOPE = 200
BLANK_LINE = r"\n[ \t\r]*\n"
BREAK = len(KINDS) + 1

SPAN = "struct<start: bigint, kind: int, end: bigint>"
FAR = 1 << 60
PARTS = ("identifier", "secret", "endpoint")
#: Items of an array that are folded together.
PIECE = 256


def running(items: Column, zero: Column, state: str, step, emit, out: str) -> Column:
    """Prefix scan of an array: ``emit(state, item)`` for each item with the state left by those before it.

    The array is folded in pieces of ``PIECE`` items, so that the work stays in proportion to its length. ``state`` and
    ``out`` are the types of the state and of what is emitted.
    """

    def over_pieces(pieces: Column) -> Column:
        begun = F.aggregate(
            pieces,
            F.struct(zero.cast(state).alias("state"), F.array().cast(f"array<{state}>").alias("before")),
            lambda done, piece: F.struct(
                F.aggregate(piece, done["state"], step).alias("state"),
                F.concat(done["before"], F.array(done["state"])).alias("before"),
            ),
            lambda done: done["before"],
        )
        emitted = lambda piece, first: F.aggregate(
            piece,
            F.struct(first.alias("state"), F.array().cast(f"array<{out}>").alias("out")),
            lambda done, item: F.struct(
                step(done["state"], item).alias("state"),
                F.concat(done["out"], F.array(emit(done["state"], item))).alias("out"),
            ),
            lambda done: done["out"],
        )
        return let(begun, lambda before: F.flatten(F.transform(pieces, lambda piece, i: emitted(piece, F.get(before, i)))))

    def cut(whole: Column) -> Column:
        last = F.greatest(F.ceil(F.size(whole) / PIECE).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(whole, n * PIECE + 1, PIECE))

    return let(items, lambda whole: let(cut(whole), over_pieces))


def matches(content: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans; code points, end exclusive.

    The text between matches comes from a split on the same pattern, so positions are running sums.
    """
    number = KINDS.index(kind) + 1 if kind in KINDS else BREAK
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    def piece(match: Column, gap: Column) -> Column:
        return F.struct(
            F.length(gap).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"),
            (keep(match) if keep else F.lit(True)).alias("kept"),
        )

    pieces = let(F.split(content, pattern, -1), lambda gaps: F.transform(found, lambda m, i: piece(m, F.get(gaps, i))))
    spans = running(
        pieces,
        F.lit(0),
        "bigint",
        lambda at, x: at + x["gap"] + x["size"],
        lambda at, x: F.struct(
            (at + x["gap"]).alias("start"),
            F.when(x["kept"], number).otherwise(0).alias("kind"),
            (at + x["gap"] + x["size"]).alias("end"),
        ),
        SPAN,
    )
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(content.rlike(pattern), F.filter(spans, lambda s: s["kind"] > 0)).otherwise(empty)


def long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= SHORTEST_VALUE


def _role_is(kind: Column, role: str) -> Column:
    return kind.isin([KINDS.index(k) + 1 for k in KINDS if ROLES[k] == role])


def _near(parts: Column, scope: int, back: bool) -> Column:
    """For each part in order: whether each role has a part in its block or within the scope before it (``back``: after it).

    The ends of blocks are among the parts.
    """
    away = F.lit(FAR if back else -FAR).cast("long")

    def step(seen: Column, part: Column) -> Column:
        edge = lambda r: F.least(seen[r], part["start"]) if back else F.greatest(seen[r], part["end"])
        edges = [F.when(_role_is(part["kind"], r), edge(r)).otherwise(seen[r]).alias(r) for r in PARTS]
        held = [((seen[f"{r}_here"] | _role_is(part["kind"], r)) & (part["kind"] != BREAK)).alias(f"{r}_here") for r in PARTS]
        return F.struct(*edges, *held)

    def close(seen: Column, part: Column) -> Column:
        within = lambda r: seen[r] <= part["end"] + scope if back else seen[r] >= part["start"] - scope
        return F.struct(*[(within(r) | seen[f"{r}_here"]).alias(r) for r in PARTS])

    swept = running(
        F.reverse(parts) if back else parts,
        F.struct(*[away.alias(r) for r in PARTS], *[F.lit(False).alias(f"{r}_here") for r in PARTS]),
        f"struct<{', '.join([f'{r}: bigint' for r in PARTS] + [f'{r}_here: boolean' for r in PARTS])}>",
        step,
        close,
        f"struct<{', '.join(f'{r}: boolean' for r in PARTS)}>",
    )
    return F.reverse(swept) if back else swept


def linked(parts: Column, before: Column, after: Column) -> Column:
    """The weak parts whose complement is near."""
    def reported(part: Column, i: Column) -> Column:
        checks = F.lit(False)
        for kind, wanted in COMPLEMENTS.items():
            found = F.lit(False)
            for role in wanted:
                found = found | F.get(before, i)[role] | F.get(after, i)[role]
            checks = checks | ((part["kind"] == KINDS.index(kind) + 1) & found)
        return checks

    return F.filter(parts, reported)


def scan_secrets(uploads: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Certain secrets and linked credential parts of every upload.

    ``uploads``: ``content`` and the ``carry`` columns. Returns the carried columns, ``certain`` and ``linked``: spans (``start``,
    ``kind`` numbered as in ``KINDS``, ``end``) in order, by code points of the whole text, end exclusive. A weak part is linked to
    complements in its block (no blank line between them), however far, and within ``scope`` characters in any other.

    A missing text is an empty one and has no spans; every row is scanned by itself, so repeated rows
    repeat their spans and an empty table stays empty.
    """
    text = F.col("__text")
    base = uploads.select(*[F.col(c) for c in carry], F.coalesce(F.col("content"), F.lit("")).alias("__text")).select(
        *carry,
        "__text",
        F.array_sort(
            F.concat(matches(text, ASSIGN, "assign", long_value), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))
        ).alias("certain"),
        F.concat(
            matches(text, IDENTIFIER, "identifier"), matches(text, WEAK_SECRET, "weak_secret"), matches(text, ENDPOINT, "endpoint")
        ).alias("__weak"),
    )
    # parts are compared only where there is a weak one
    parts = base.select(
        *carry,
        "certain",
        F.when(F.size("__weak") > 0, F.array_sort(F.concat("certain", "__weak", matches(text, BLANK_LINE, "break")))).alias("__parts"),
    )
    near = parts.select(
        *carry,
        "certain",
        "__parts",
        F.when(F.col("__parts").isNotNull(), _near(F.col("__parts"), scope, back=False)).alias("__before"),
        F.when(F.col("__parts").isNotNull(), _near(F.col("__parts"), scope, back=True)).alias("__after"),
    )
    return near.select(
        *carry,
        "certain",
        F.coalesce(
            F.when(F.col("__parts").isNotNull(), linked(F.col("__parts"), F.col("__before"), F.col("__after"))),
            F.array().cast(f"array<{SPAN}>"),
        ).alias("linked"),
    )


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")
