"""Rows that every operator must survive: nulls, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, id string, body string"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGE = [
    (None, None, None, None),
    (None, "", None, "a"),
    (1, None, "en", None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", None, "a"),
    (4, "x", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "same row", "en", "a"),
    (6, "same row", "en", "a"),
    (7, "\U0001f600 \u00e9t\u00e9 \u0130stanbul \u2603 token=abc\U0001f600def", None, None),
    (8, "!!! 123 ...", "en", "c"),
]


def make(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, l, s, len(t or ""), "m", "i", "b") for d, t, l, s in rows], SCHEMA)
