from __future__ import annotations

import random

import numpy as np
from llm_rows import EDGE, make

from tidemark.llm import toxicity


def brute_segments(scores):
    """Recursively: the best contiguous run, then what lies left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    start, end = -best[2], -best[2] - best[1]
    left = brute_segments(scores[:start])
    right = [(a + end, b + end) for a, b in brute_segments(scores[end:])]
    return left + [(start, end)] + right


def test_segments_match_the_definition():
    draw = random.Random(3)
    for _ in range(300):
        # Distinct sums leave no ties.
        scores = [draw.choice([-1, 1]) * draw.randint(1, 9) + draw.random() * 1e-3 for _ in range(draw.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute_segments(scores)


def test_compressed_runs_give_the_same_segments():
    draw = random.Random(4)
    for _ in range(200):
        scores = np.array([draw.choice([-0.5, -0.5, 2.0 + draw.random()]) for _ in range(draw.randint(1, 60))])
        starts, short = toxicity.compressed(scores)
        ends = np.r_[starts[1:], len(scores)]
        got = [(int(starts[a]), int(ends[b - 1])) for a, b, _ in toxicity.segments(short)]
        assert got == [(a, b) for a, b, _ in toxicity.segments(scores.tolist())]


def corpus(n=600):
    draw = random.Random(5)
    vocabulary = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    bad = ["vilest", "vilely", "rotter", "scummy"]
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(vocabulary, k=draw.choice([5, 50, 400]))
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(draw.randint(0, len(words)), draw.choice(bad))
        rows.append((1000 + i, " ".join(words), None, None))
        labels.append((1000 + i, toxic))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    df = make(spark, rows + EDGE)
    marks = spark.createDataFrame(labels + [(None, 1), (1000, None), (99999, 1)], "doc_id long, toxic int")
    learned = marks.filter(~toxicity.held_out())
    model = toxicity.fit(toxicity.labelled_rows(df, learned, "text", "doc_id", "toxic", 10_000))
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = {r.doc_id for r in marks.filter(toxicity.held_out()).collect()}
    wrong = [r.id for r in got if r.id in held and r.id in truth and r.predicted != truth[r.id]]
    assert len(held) > 60 and len(wrong) <= 2
    assert {r.predicted for r in got if r.id in (None, 1, 2, 3, 4, 5, 6)} == {0}
    toxic_passages = [r.passages for r in got if truth.get(r.id) == 1]
    assert all(p for p in toxic_passages)


def test_no_labels_and_empty_table(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    df = make(spark, EDGE)
    model = toxicity.fit(toxicity.labelled_rows(df, marks, "text", "doc_id", "toxic", 100))
    assert model.weights == {} and {r.predicted for r in toxicity.score_toxicity(df, model).collect()} == {0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_repeated_ids_do_not_multiply(spark):
    """Many texts of one id are one text of the sample, not pairs of all of them."""
    rows = [(1, f"text {i} of one id", None, None) for i in range(300)] + [(i, f"own text {i}", None, None) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    sample = toxicity.labelled_rows(make(spark, rows), labels, "text", "doc_id", "toxic", 1000)
    assert sample.count() == 39 and sorted(sample.columns) == ["body", "id", "toxic"]
    again = toxicity.labelled_rows(make(spark, rows[::-1]), labels, "text", "doc_id", "toxic", 1000)
    assert {r.body for r in again.collect()} == {r.body for r in sample.collect()}
