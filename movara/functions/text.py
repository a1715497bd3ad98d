"""Text normalisation as native Spark column expressions, with the same rules for names held as schema."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from movara.functions.columns import as_col, let

#: Texts within these characters fold one by one; the common case in European languages.
SIMPLE_END = 0x24F
PAGE = 256
#: Stands for a character that folds to several or to none; a text that holds it is folded character by character.
OTHER = "\x01"

#: After folding and lower-casing, by separator: the runs that it replaces. Java walks a class of one kind of part many times
#: faster than the same characters written as two ranges and a sign.
JOINING = {"_": "[^a-z0-9]+", " ": r"\W+"}


@lru_cache(maxsize=1)
def foldings() -> dict[int, str]:
    """Code points whose compatibility decomposition without combining marks differs from them.

    Derived from the Unicode database over its whole range; a mark folds to nothing.
    """
    changed = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFKD", chr(code))
        kept = "".join(part for part in parts if unicodedata.combining(part) == 0)
        if kept != chr(code):
            changed[code] = kept
    return changed


@lru_cache(maxsize=1)
def _simple() -> tuple[str, str, str]:
    """For ``translate``: letters with one substitute, characters within ``SIMPLE_END`` without one, whose place takes ``OTHER``,
    and marks, which go; the substitutes; the class of all characters beyond ``SIMPLE_END`` but those marks."""
    single = {c: f for c, f in foldings().items() if c <= SIMPLE_END and len(f) == 1}
    marks = [c for c in range(0x300, 0x340) if foldings().get(c) == ""]  # an unbroken run of marks
    many = [c for c in range(SIMPLE_END + 1) if len(foldings().get(c, "x")) != 1]
    source = "".join(map(chr, [*single, *many, *marks]))
    beyond = f"[^\\x{{0}}-\\x{{{SIMPLE_END:x}}}\\x{{{marks[0]:x}}}-\\x{{{marks[-1]:x}}}]"
    return source, "".join(single.values()) + OTHER * len(many), beyond


@lru_cache(maxsize=1)
def _pages() -> tuple[str, str]:
    """All foldings as two separated texts: the place of every page, and the pages' substitutes.

    A page has a substitute for each of its characters, itself where it stays; ASCII is not looked up.
    """
    held = sorted({code // PAGE for code in foldings()})
    place = {page: n for n, page in enumerate(held)}
    places = ",".join(str(place.get(page, "")) for page in range(max(held) + 1))
    shown = lambda code: chr(code) if code >= 0x80 and not 0xD800 <= code <= 0xDFFF else ""
    codes = (page * PAGE + n for page in held for n in range(PAGE))
    return places, "\x01".join(foldings().get(code, shown(code)) for code in codes)


def strip_accents(value) -> Column:
    """Compatibility characters decomposed and combining marks dropped, in every script."""

    def wide(text: Column) -> Column:
        # splits of literals are folded to constant arrays when the query is planned
        places, substitutes = (F.split(F.lit(t), by, -1) for t, by in zip(_pages(), (",", "\x01"), strict=True))

        def substitute(code: Column) -> Column:
            place = F.get(places, F.shiftright(code, 8)).try_cast("int")
            return F.when(code >= 0x80, F.get(substitutes, place * PAGE + code.bitwiseAND(PAGE - 1)))

        return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(substitute(F.ascii(c)), c)), "")

    source, target, beyond = _simple()
    letters = lambda text: let(F.translate(text, source, target), lambda t: F.when(t.contains(OTHER), wide(text)).otherwise(t))
    return let(
        value,
        lambda text: F.when(F.octet_length(text) == F.length(text), text).when(text.rlike(beyond), wide(text)).otherwise(letters(text)),
    )


def folded(value) -> Column:
    """The text compared without accents and capitals: groups, joins and filters on it take spellings together.

    The text itself stays as it is; no row is rewritten.
    """
    return F.collate(as_col(value).cast("string"), "UNICODE_CI_AI")


def normalize(value, separator: str = "_") -> Column:
    """Accent-free lower-case text where runs of other characters become the separator."""
    joined = F.regexp_replace(F.lower(strip_accents(value)), JOINING[separator], separator)
    return F.btrim(joined, F.lit(separator))


def slug(value) -> Column:
    return F.btrim(F.regexp_replace(normalize(value), "[^a-z0-9]+", "_"), F.lit("_"))


def blank_to_null(value) -> Column:
    """Trimmed text, with blank cells read as missing."""
    return F.nullif(trim_all(value), F.lit(""))


def trim_all(value) -> Column:
    return F.btrim(as_col(value), F.lit(" \t\n\r\f\v"))


def normalize_name(name: str, separator: str = "_") -> str:
    """``normalize`` of a name that is schema, from the same foldings and patterns."""
    return re.sub(JOINING[separator], separator, name.translate(foldings()).lower(), flags=re.ASCII).strip(separator)
