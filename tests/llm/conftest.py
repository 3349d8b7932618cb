"""Fixtures of the tests of training-data operators."""

from __future__ import annotations

import random

import pytest
from llm_rows import EDGE, make


@pytest.fixture
def edge(spark):
    return make(spark, EDGE)


@pytest.fixture
def empty(spark):
    return make(spark, [])


@pytest.fixture
def prose():
    """Random texts with copies, near copies and shared passages."""
    draw = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnrst"]
    shared = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(3)]
    rows = []
    for i in range(120):
        kind = draw.random()
        if rows and kind < 0.2:
            text = draw.choice(rows)[1]
        elif kind < 0.4:
            words = draw.choices(vocabulary, k=draw.randint(0, 90))
            words.insert(draw.randint(0, len(words)), draw.choice(shared))
            text = "\n".join(words) if draw.random() < 0.3 else " ".join(words)
        elif kind < 0.5:
            text = " ".join([draw.choice(vocabulary)] * draw.randint(1, 120))
        else:
            text = " ".join(draw.choices(vocabulary, k=draw.randint(0, 200)))
        rows.append((100 + i, text, "en", draw.choice(["a", "b", None])))
    return rows
