"""Shared pieces of the tests: awkward uploads and plain versions of what the operators count."""

import re

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

#: (dataset_id, file_name, content): nulls, empties, ties, exact repeats, one very long text.
AWKWARD = [
    (1, "sales.csv", "product;region;amount\nchair;north;1.234,56"),
    (1, "sales.csv", "product;region;amount\nchair;north;1.234,56"),
    (2, None, None),
    (3, "", ""),
    (None, "stock.csv", "table;south;99"),
    (4, "stock.csv", "table;south;99"),
    (5, "é🙂.csv", "ÀÉ déjà vu 🙂 STRASSE straße\x85x y"),
    (6, "stock.csv", "word " * 60_000),
    (7, "sales.csv", " \t\r\n "),
]

SCHEMA = "dataset_id long, file_name string, content string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def frame(spark, rows=AWKWARD):
    """Uploads with extra columns whose names the operators use themselves."""
    extra = ("x", 1, 2.0)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + ", fingerprint string, size int, score double").repartition(3)
