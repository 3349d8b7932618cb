from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from llm_rows import EDGE, make

from tidemark.llm import decontaminate as d


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    found = set()
    for doc, text, *_ in docs:
        a = tokens(text)
        for item, other in items:
            b = tokens(other)
            index = {}
            for q in range(len(b) - d.SPAN + 1):
                for m, mask in enumerate(d.MASKS):
                    index.setdefault((m, tuple(b[q + i] for i, x in enumerate(mask) if x == "1")), []).append(q)
            for p in range(len(a) - d.SPAN + 1):
                for m, mask in enumerate(d.MASKS):
                    for q in index.get((m, tuple(a[p + i] for i, x in enumerate(mask) if x == "1")), ()):
                        same = [
                            int(0 <= p + o < len(a) and 0 <= q + o < len(b) and a[p + o] == b[q + o])
                            for o in range(-d.OVERLAP, d.SPAN + d.OVERLAP)
                        ]
                        run = min(len(b), d.OVERLAP)
                        least = run - run * d.SUBSTITUTIONS // d.OVERLAP
                        if any(sum(same[s : s + run]) >= least for s in range(len(same) - run + 1)):
                            found.add((doc, item, p))
    out = {}
    for doc, item, p in found:
        out.setdefault((doc, item), []).append(p)
    return sorted(((doc, item, len(p), min(p), max(p) + d.SPAN) for (doc, item), p in out.items()), key=str)


def corpus():
    draw = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=k))) for i, k in enumerate([9, 10, 11, 15, 30, 30, 80])]
    items += [(100, None), (101, ""), (None, " ".join(draw.choices(vocabulary, k=20))), (4, items[4][1])]
    docs = []
    for i in range(120):
        words = draw.choices(vocabulary, k=draw.randint(0, 80))
        if i % 2:
            passage = (draw.choice(items)[1] or "").split()
            for _ in range(draw.choice([0, 1, 3, 8])):
                if passage:
                    passage[draw.randrange(len(passage))] = "changed"
            cut = draw.randint(0, max(0, len(passage) // 2))
            words[5:5] = passage[cut:]
        docs.append((1000 + i, ", ".join(words).upper(), None, None))
    return docs, items


@pytest.mark.parametrize("per_pass", [250_000, 100])
def test_matches_brute_force(spark, per_pass):
    docs, items = corpus()
    docs = docs + EDGE
    tests = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, seed string")
    got = d.find_overlaps(make(spark, docs), tests, seeds_per_pass=per_pass)
    rows = [(r.id, r.item, r.n_hits, r.first_token, r.last_token) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, sorted(set(items), key=str))
    assert len(rows) > 20


def test_drop_keeps_clean_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, f"a {passage} b", None, None), (2, "a b", None, None), (2, "a b", None, None), (None, passage, None, None), (None, None, None, None)]
    df = make(spark, docs)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = d.drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("2", "a b")] * 2 and kept.count() == 3


def test_empty_tables(spark, empty, edge):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert d.find_overlaps(empty, items).count() == 0
    assert d.find_overlaps(edge, items.limit(0)).count() == 0
    assert d.drop_contaminated(edge, items.limit(0)).count() == edge.count()


def test_masks_leave_a_seed_for_every_substitution():
    for length in range(1, d.OVERLAP + 1):
        masks = d.MASKS if length >= d.SPAN else d.short_masks(length, d.OVERLAP, d.SUBSTITUTIONS)
        for gone in combinations(range(length), length * d.SUBSTITUTIONS // d.OVERLAP):
            assert any(
                all(bit == "0" or at + o not in gone for o, bit in enumerate(mask))
                for mask in masks
                for at in range(length - len(mask) + 1)
            )


def accepted(a, b):
    """Mask-free: whether some aligned run of tokens differs in few enough places; scant items are whole texts."""
    if len(b) < d.LEAST:
        return a == b
    run = min(len(b), d.OVERLAP)
    least = run - run * d.SUBSTITUTIONS // d.OVERLAP
    return run > 0 and any(
        sum(x == y for x, y in zip(a[p : p + run], b[q : q + run])) >= least
        for p in range(len(a) - run + 1)
        for q in range(len(b) - run + 1)
    )


def test_every_accepted_overlap_is_found(spark):
    draw = random.Random(4)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in range(1, 14)] + [(20, [f"i20x{k}" for k in range(20)])]
    docs = []
    for n, words in items:
        run = min(n, d.OVERLAP)
        allowed = run * d.SUBSTITUTIONS // d.OVERLAP
        for gone in [c for k in (0, allowed, allowed + 1) for c in combinations(range(run), k)]:
            passage = ["changed" if k in gone else w for k, w in enumerate(words[:run])]
            docs.append(["x", "y", *passage, "z"])
    docs = draw.sample(docs, 300) + [["x", *w, "y"] for _, w in items]
    tests = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    found = d.find_overlaps(make(spark, [(i, " ".join(w), None, None) for i, w in enumerate(docs)]), tests)
    want = {(i, n) for i, a in enumerate(docs) for n, b in items if accepted(a, b)}
    assert {(r.id, r.item) for r in found.collect()} == want and len(want) > 60


def test_items_in_scripts_without_spaces(spark):
    """Letters of such scripts are tokens, so an item is found inside a longer run of them; marks split no token."""
    draw = random.Random(9)
    run = "".join(chr(draw.randrange(0x4E00, 0x9F00)) for _ in range(48))
    thai = "".join(chr(draw.randrange(0x0E01, 0x0E2E)) + "\u0e31" for _ in range(20))
    marked = " ".join(f"a{i}e\u0301x" for i in range(14))
    items = spark.createDataFrame([(1, run), (2, thai), (3, marked)], "item_id long, text string")
    docs = [(10, "x" + run[:20] + "\u3042" * 9 + run + "\u4e00" * 30), (11, "y " + thai + "\u0e02"), (12, marked.upper() + " end"),
            (13, run[:9] + " other"), (14, marked.replace("\u0301", " "))]
    found = d.find_overlaps(make(spark, [(i, t, None, None) for i, t in docs]), items).collect()
    assert sorted((r.id, r.item) for r in found) == [(10, 1), (11, 2), (12, 3)]


def test_scant_items_match_whole_texts_only(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "not at all"), (3, "five words are enough here")], "item_id long, text string")
    docs = [(10, "yes, but no"), (11, "YES!"), (12, "Not at all."), (13, "it is not at all so"),
            (14, "see: five words are enough here, too"), (15, "not at some")]
    found = d.find_overlaps(make(spark, [(i, t, None, None) for i, t in docs]), items).collect()
    assert sorted((r.id, r.item) for r in found) == [(11, 1), (12, 2), (14, 3)]
    kept = d.drop_contaminated(make(spark, [(i, t, None, None) for i, t in docs]), items)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 13, 15]


def test_filter_is_not_in_the_plan(spark):
    docs, items = corpus()
    plan = d.find_overlaps(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert len(plan._jdf.queryExecution().toString()) < 400_000
