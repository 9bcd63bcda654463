"""Small tables and brute-force helpers for the operator tests."""

from __future__ import annotations

import re
import string
import zlib

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, Score double, row int, part int"


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def documents(spark, rows):
    """A documents table with extra columns whose names clash with results; rows are (doc_id, text, source)."""
    return spark.createDataFrame(
        [(i, t, None, s, None if t is None else len(t), "x", None, 1, None) for i, t, s in rows], SCHEMA)


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{n % 997} v{n % 89}" for n in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "One two three four five six.", None), (3, "One two three four five six.", None),
            (None, "one TWO three four five six.", "b"), (None, None, None), (4, "é É ñ   x", "b"), (5, "short", "b"),
            (5, "another text of the same id", "c"), (6, long_text, "c"), (7, long_text + " tail", "c"), (8, " \t\n ", ""),
            (9, "token = \"abcdef0123456789abcdef0123456789\"\nReleased under the MIT License.", "a")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [(1, "x", "y")]).where("doc_id < 0")


def crc(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def blank_words(text: str | None) -> list[bytes]:
    return lowered(text).encode().split()
