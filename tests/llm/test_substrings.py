from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import EDGE, make

from tidemark.llm import substrings


def brute(rows, size):
    texts = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    out = []
    for d, w in texts:
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [35, 8, 2])
def test_matches_brute_force(spark, prose, size):
    rows = prose + EDGE
    found = substrings.drop_repeated_passages(make(spark, rows), size=size)
    got = [(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows, size)
    for r in found.collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_covers_are_difference_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_windows_hash_by_content():
    words = [b"a", b"b", b"c", b"x", b"a", b"b", b"c"]
    roller = substrings.Roller()
    got = roller.windows(roller.word_hashes(words), np.array([0, 4, 1]), 3, 0)
    assert got[0] == got[1] != got[2]


def test_empty_table(empty):
    assert substrings.drop_repeated_passages(empty).count() == 0
