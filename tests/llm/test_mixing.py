from __future__ import annotations

import random
import re

import pytest
from llm_rows import EDGE, make

from tidemark.llm import mixing


def brute_targets(sizes, weights, most):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    left = total
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > most * sizes[s]}
        if not over:
            target.update({s: weight[s] * rate for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(n=700):
    draw = random.Random(2)
    names = ["big"] * 6 + ["a", "b", "c", "Z", None, "tiny"]
    return [(i, "w " * draw.choice([0, 1, 30, 300, 3000]), None, draw.choice(names)) for i in range(n)] + EDGE


@pytest.mark.parametrize("chunk,fan_in", [(4096, 256), (5, 2)])
def test_targets_sums_and_bounds(spark, chunk, fan_in):
    rows = corpus()
    got = mixing.mix_sources(make(spark, rows), chunk=chunk, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = brute_targets(sizes, (5, 2, 1), 3)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken >= r.copies * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), 0)
        by_size[(r.source_size, round(r.target, 6))] += r.taken
    assert set(by_size) == {(sizes[s], round(target[s], 6)) for s in sizes}
    for (_, aimed), taken in by_size.items():
        assert abs(taken - aimed) <= 1 * sum(1 for s in sizes if round(target[s], 6) == aimed)
    assert sorted((r.id, r.size) for r in got if r.id is not None) == sorted((d, words(t)) for d, t, *_ in rows if d is not None)


def test_reruns_agree(spark):
    df = make(spark, corpus())
    key = lambda rows: sorted((str(r.id), r.size, r.taken) for r in rows)
    first = key(mixing.mix_sources(df, chunk=16, fan_in=4).collect())
    assert first == key(mixing.mix_sources(df.repartition(5), chunk=16, fan_in=4).collect())
    assert first != key(mixing.mix_sources(df, chunk=16, fan_in=4, seed=7).collect())


def test_pivot_keeps_mass_and_expectation():
    draw = random.Random(1)
    for _ in range(50):
        left, right = (draw.randint(1, 50), draw.uniform(0.01, 0.99)), (draw.randint(1, 50), draw.uniform(0.01, 0.99))
        steps = 4000
        mean = 0.0
        for k in range(steps):
            (_, p), (_, q) = mixing.pivot(left, right, (k + 0.5) / steps)
            assert left[0] * p + right[0] * q == pytest.approx(left[0] * left[1] + right[0] * right[1])
            assert min(abs(p), abs(1 - p), abs(q), abs(1 - q)) < 1e-9 and -1e-9 <= p <= 1 + 1e-9
            mean += p / steps
        assert mean == pytest.approx(left[1], abs=2e-3)


def test_empty_and_wordless_tables(spark, empty):
    assert mixing.mix_sources(empty).count() == 0
    rows = [(1, None, None, "a"), (2, "", None, None)]
    assert {(r.id, r.size, r.target, r.taken) for r in mixing.mix_sources(make(spark, rows)).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
