from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from llm_rows import EDGE
from pyspark.sql import functions as F

from tidemark.llm import fill_middle


def brute(text, key, units):
    """The same cuts by plain slicing of a list of units."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text)
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (parts[:low], parts[low:high], parts[high:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def words(text):
    """Words with what stands before them; what follows the last one is a unit."""
    found = re.findall(r"\s*\S+", text)
    rest = text[len("".join(found)) :]
    return found + ([rest] if rest else [])


ROWS = [(i, t) for i, (_, t, *_) in enumerate(EDGE)] + [
    (100, "a<P>b"), (101, "cut <S> here"), (102, "<M>"), (103, "<"), (104, "<<S"), (105, "S><P M> <P"), (106, "\U0001f600" * 50),
    (107, "é" * 40), (108, "a\x00b\r\nc"), (109, "  "),
]


@pytest.mark.parametrize("unit, units", [(None, list), (r"\S+", words)])
def test_matches_slicing(spark, unit, units):
    draw = random.Random(3)
    more = [(200 + i, "".join(draw.choices("ab<PSM> \né\U0001f601", k=draw.randrange(120)))) for i in range(300)]
    rows = [*ROWS, *more, more[0], (None, "text of a row without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("id", "n", "form", "h0")})
    found = fill_middle.fill_in_middle(df, unit=unit)
    got = found.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    wanted = sorted(((k, *brute(t, k, units)) for k, t in rows), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == wanted
    texts = {k: t or "" for k, t in rows}
    assert all(r.again == texts[r.id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_skip_list_finds_every_rank():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 8, 9, 300, 5000):
        points = draw.integers(1, 9, n)
        lanes = fill_middle.SkipList(points, draw)
        ends = np.r_[0, np.cumsum(points)]
        ranks = range(n + 1) if n < 400 else draw.integers(0, n + 1, 200)
        assert all(lanes.points_before(r) == ends[r] for r in ranks)
        for units, spans, _ in lanes.lanes:
            assert len(units) == len(spans) and units.sum() <= n
        assert n < 300 or len(lanes.lanes) > 2


def test_edge_rows_and_empty_table(edge, empty):
    assert fill_middle.fill_in_middle(edge).count() == len(EDGE)
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("x", "one text"), (None, None)], "doc_id string, text string")
    assert {r.id for r in fill_middle.fill_in_middle(df).collect()} == {"x", None}
