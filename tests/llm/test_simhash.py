from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, extra string"


def brute_print(text: str | None, size: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, size: int, distance: int) -> list[tuple]:
    prints = [brute_print(text, size) for _, text in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= distance:
                parent[root(p)] = root(q)
    least: dict = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    found = [(doc, format(p, "016x"), least.get(root(p))) for (doc, _), p in zip(rows, prints)]
    return sorted(found, key=str)


def spark_result(df, **options) -> list[tuple]:
    found = simhash.near_duplicates(df, **options).select("id", "fingerprint", "component_id").collect()
    return sorted((tuple(r) for r in found), key=str)


def corpus(n: int = 150, seed: int = 5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.5:
            words = (draw.choice(rows)[1] or "x").split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        else:
            words = draw.choices(vocabulary, k=draw.choice([1, 3, 5, 60, 300, 900]))
        rows.append((i, " ".join(words)))
    return rows


EDGE_ROWS = [(None, "a b c d e"), (None, None), (7, ""), (7, ""), (8, " \t\n"), (9, "Ärger A B c d"), (9, "other text")]


def test_matches_brute_force(spark):
    rows = corpus() + [(1000 + i, t) if d is not None else (None, t) for i, (d, t) in enumerate(EDGE_ROWS)] + EDGE_ROWS
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert spark_result(df) == brute(rows, 4, 4)


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "SHORT_RUN", 4)
    monkeypatch.setattr(simhash, "CROWD", 1000)
    rows = corpus(seed=6)
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert spark_result(df) == brute(rows, 4, 4)


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    whole = simhash.fingerprint(text, 4, 2)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert (simhash.fingerprint(text, 4, 2) == whole).all()


@pytest.mark.parametrize("rows", [100, 10**6, 10**9])
def test_pigeonhole_masks_catch_every_pair(rows):
    masks = simhash.pigeonhole_masks(64, 4, rows)
    draw = random.Random(3)
    for _ in range(200):
        flips = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(not (m[0] & flips) for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 200)]
    found = {r.vertex: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    draw = random.Random(1)
    words = [f"word{draw.randrange(5000)}" for _ in range(600)]
    near = list(words)
    near[100], near[400] = "changed", "again"
    other = [f"other{draw.randrange(5000)}" for _ in range(600)]
    rows = [(3, " ".join(words)), (2, " ".join(near)), (4, " ".join(words)), (5, " ".join(other)), (5, " ".join(other))]
    rows += [(None, " ".join(other)), (None, None), (None, ""), (6, "")]
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA).withColumn("mark", F.lit("own")).withColumn(
        "root", F.lit("own")
    )
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_distances_count_the_sign_bit():
    draw = random.Random(2)
    for lanes in (1, 4):
        left = np.array([[draw.getrandbits(64) for _ in range(lanes)] for _ in range(200)], np.uint64).view(np.int64)
        right = np.array([[draw.getrandbits(64) for _ in range(lanes)] for _ in range(200)], np.uint64).view(np.int64)
        wanted = [sum(((int(a) ^ int(b)) & (2**64 - 1)).bit_count() for a, b in zip(*r)) for r in zip(left, right)]
        assert simhash.differing(left, right).tolist() == wanted


def test_links_across_every_bit(spark):
    """Fingerprints a few bits apart in any position, the sign bit included, are all linked."""
    draw = random.Random(8)
    rows = []
    for i in range(60):
        base = draw.getrandbits(64)
        flips = {63, *draw.sample(range(63), 3)} if i % 2 else set(draw.sample(range(64), 4))
        other = base ^ sum(1 << b for b in flips)
        rows += [(simhash.signed(base),), (simhash.signed(other),)]
    df = spark.createDataFrame(rows, "l0 long")
    found = simhash.links(df, ["l0"], simhash.pigeonhole_masks(64, 4, len(rows)), 4).count()
    assert found == 60


def jaccard(left: str | None, right: str | None, size: int = 5) -> float:
    sets = []
    for text in (left, right):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_kept(rows, similarity: float = 0.8) -> list:
    """The least id of every component of pairs with the similarity."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and jaccard(rows[i][1], rows[j][1]) >= similarity - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group) if g == k) for k in set(group))


def similar_rows(pairs: int):
    """Pairs a little above and below the similarity, groups around one text, shared passages and repeated lines."""
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.choices(vocabulary, k=40)
    line = draw.choices(vocabulary, k=6)
    texts = []
    for i in range(pairs):
        words = draw.choices(vocabulary, k=draw.choice([4, 5, 9, 60, 200]))
        if i % 3 == 0:
            words += passage
        if i % 5 == 0:
            words += line * 40
        other = list(words)
        # Each changed word costs up to five shingles, so this straddles 0.8.
        for _ in range(round(len(words) * draw.uniform(0, 0.035))):
            other[draw.randrange(len(other))] = draw.choice(vocabulary)
        texts += [words, other, other[: round(len(other) * draw.uniform(0.75, 1))]]
    base = draw.choices(vocabulary, k=150)
    for _ in range(40):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(150)] = draw.choice(vocabulary)
        texts.append(words)
    draw.shuffle(texts)
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize("common", [0, 200_000])
def test_drop_matches_exact_similarity(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    rows = similar_rows(70)
    near = [jaccard(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i]]
    assert sum(0.8 <= x < 0.85 for x in near) > 10 and sum(0.7 < x < 0.8 for x in near) > 10
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == brute_kept(rows)


def test_no_pair_at_the_similarity_is_missed(spark):
    """Pairs at 0.80 to 0.81, which fingerprint keys would miss now and then."""
    draw = random.Random(21)
    rows = []
    for i in range(400):
        words = [f"v{i}x{k}" for k in range(204)]
        other = list(words)
        # Four changes, each in five shingles of 200: 180 of 220 in common; a longer end takes it near 0.8.
        for at in (20, 70, 120, 170):
            other[at] = "changed"
        other += [f"z{i}x{k}" for k in range(4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert 0.8 <= jaccard(rows[0][1], rows[1][1]) < 0.81
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [2 * i for i in range(400)]


def test_parity_fingerprints_never_differ_more_than_their_sets():
    draw = np.random.default_rng(4)
    for n, m, lanes in ((5, 4, 1), (60, 66, 1), (900, 1000, 8), (1, 1, 8)):
        pool = draw.integers(-(2**62), 2**62, n + m)
        left, right = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        apart = len(np.setxor1d(left, right))
        prints = [simhash.parity(s, lanes)[None, :] for s in (left, right)]
        assert simhash.differing(*prints)[0] <= apart
        assert simhash.differing(prints[0], prints[0])[0] == 0
    sizes = np.array([10, 10, 9, 8, 7])
    # Of 10 and 8 shingles similar sets may differ in 2, of 10 and 10 in 2 of 20 by the bound of 2.2.
    assert simhash.near_sets(sizes, np.full(5, 10), np.array([2, 3, 2, 2, 0]), 0.8).tolist() == [True, False, True, True, False]


def test_a_crowded_key_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 5)
    rows = similar_rows(25)
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == brute_kept(rows)


def test_drop_compares_texts_with_linked_fingerprints(spark, monkeypatch):
    """The SimHash step by itself: without the prefix join near copies go by their fingerprints, after the exact check."""
    listed = simhash.postings
    monkeypatch.setattr(simhash, "postings", lambda *a: listed(*a).limit(0))
    draw = random.Random(31)
    rows = []
    for i in range(30):
        words = [f"v{i}x{k}" for k in range(400)]
        other = list(words)
        other[draw.randrange(400)] = "changed"
        # A line that is repeated decides the fingerprints of these two, but their sets are unlike.
        line = [f"r{i}x{k}" for k in range(5)]
        few, many = [words[0]] + line * 60, [words[1]] + line * 60 + [f"s{i}x{k}" for k in range(8)]
        rows += [" ".join(w) for w in (words, other, few, many)]
    rows = list(enumerate(rows))
    prints = [brute_print(t, 5) for _, t in rows]
    links = {(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4}
    similar = {p for p in links if jaccard(rows[p[0]][1], rows[p[1]][1]) >= 0.8}
    assert len(similar) > 20 and len(links - similar) > 5
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, _ in rows} - {j for _, j in similar}


def test_fingerprint_pairs_are_links_of_every_linked_text(spark):
    rows = corpus(seed=9) + [(900, "p q r"), (901, "P q  r")]
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    prints = simhash.fingerprints(df, "text", "doc_id", 5, 64)
    of = {r.mark: r.l0 & (2**64 - 1) for r in prints.collect()}
    linked = {m for m in of if any(m != o and (of[m] ^ of[o]).bit_count() <= 4 for o in of)}
    pairs = [tuple(r) for r in simhash.fingerprint_pairs(prints, ["l0"], 4).collect()]
    assert len(pairs) == len(set(pairs)) and all(u < v and (of[u] ^ of[v]).bit_count() <= 4 for u, v in pairs)
    assert {m for p in pairs for m in p} == linked and len(linked) > 20
    assert len(pairs) <= 2 * len(of)


@pytest.mark.parametrize("distance", [0, 4])
def test_fingerprints_change_the_work_and_not_the_rows(spark, distance):
    rows = similar_rows(20)
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, distance=distance).collect()) == brute_kept(rows)
