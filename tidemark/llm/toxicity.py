"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens and their beginnings are weighed by the log-odds of their frequencies in
toxic and clean texts under a Dirichlet prior in proportion to the whole corpus.
A token counts once for each distinct word before it, so that copies of a text,
exact or near, add nothing. A text is scanned once: the linear-time algorithm for all maximal
scoring subsequences returns every passage. Scores of segments are compared with
what clean text of the same length gives by chance (Karlin-Altschul statistics),
and a logistic curve fitted on a bounded sample turns the sum of the significant
passages' bits into the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

#: Lengths of the word beginnings that stand in for rare words.
BEGINNINGS = (4, 5, 6)
#: Weight of the Dirichlet prior of a token, split as the classes' totals are.
PRIOR = 1.0
#: Least evidence and log-odds of a token that counts as toxic. The evidence is a
#: log-likelihood ratio; chance gives 16 to one token in nine million, so the tokens kept
#: are no more than the bounded sample of labelled texts bears out.
LEAST_EVIDENCE = 16.0
LEAST_ODDS = 2.0
#: Score of a token outside the model.
OTHER = -0.5
LETTERS = r"[\p{L}\p{N}]+"


@dataclass
class Model:
    """Weights of toxic tokens, the scale of the segment statistics, the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    offset: float = 0.0
    curve: tuple[float, float] = (-3.0, 1.0)


def held_out(id_column: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(body: Column) -> Column:
    return F.regexp_extract_all(F.lower(body), F.lit(LETTERS), F.lit(0))


def weighed(counts: DataFrame, all_toxic: int, all_clean: int) -> DataFrame:
    """Log-odds and evidence of each ``token`` from its counts ``toxic`` and ``clean`` and the classes' totals.

    The prior follows the classes' totals, so a token in proportion to them weighs
    nothing.
    """
    share = all_toxic / (all_toxic + all_clean)
    own = {"toxic": F.col("toxic") + PRIOR * share, "clean": F.col("clean") + PRIOR * (1 - share)}
    odds = F.log(own["toxic"] / own["clean"]) - F.log(F.lit(share / (1 - share)))
    n = F.col("toxic") + F.col("clean")

    def part(name: str, expected: float) -> Column:
        return F.when(F.col(name) > 0, F.col(name) * F.log(F.col(name) / (n * expected))).otherwise(0.0)

    evidence = part("toxic", share) + part("clean", 1 - share)
    return counts.select("token", odds.alias("odds"), evidence.alias("evidence"))


def learn_tokens(labelled: DataFrame) -> dict[str, float]:
    """Toxic tokens' log-odds from rows of ``body`` and ``toxic``; beginnings carry a star.

    Without tokens of both classes nothing is learned.
    """
    words = labelled.select("toxic", tokens(F.col("body")).alias("w"))
    before = F.concat(F.array(F.lit("")), F.col("w"))
    pairs = F.zip_with("w", before, lambda w, b: F.struct(w.alias("token"), F.xxhash64(b).alias("before")))
    pairs = F.filter(pairs, lambda p: p["token"].isNotNull())
    words = words.select("toxic", F.explode(pairs).alias("pair")).select("toxic", "pair.*").distinct()
    counts = words.groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")
    )
    counts = keep_table(counts)
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not totals[0] or not totals[1]:
        return {}
    tables = [counts]
    for n in BEGINNINGS:
        longer = counts.filter(F.length("token") >= n)
        tables.append(
            longer.groupBy(F.concat(F.substring("token", 1, n), F.lit("*")).alias("token")).agg(
                F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
            )
        )
    weights: dict[str, float] = {}
    for each in tables:
        found = weighed(each, *totals).filter((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") >= LEAST_ODDS))
        weights.update({r["token"]: r["odds"] for r in found.collect()})
    return weights


def token_weight(word: str, weights: dict[str, float]) -> float:
    """The word's own weight, else that of its longest known beginning, else ``OTHER``."""
    found = weights.get(word)
    if found is not None:
        return found
    for n in reversed(BEGINNINGS):
        found = weights.get(word[:n] + "*")
        if found is not None:
            return found
    return OTHER


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time.

    Each candidate keeps the sum before its start and at its end. A new one is
    merged with the nearest earlier one whose sum before the start is lower, if
    that one's sum at the end is not higher.
    """
    stack: list[list] = []
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        # start, end, sum before, sum at the end, index of the nearest one with a lower start
        new = [at, at + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def compressed(scores: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Scores with runs of negative ones summed; also the position of each."""
    signs = scores > 0
    starts = np.flatnonzero(np.r_[True, signs[1:] | signs[:-1]]) if len(scores) else np.empty(0, np.int64)
    return starts, np.add.reduceat(scores, starts).tolist() if len(starts) else []


def passages(words: list[str], weights: dict[str, float], cache: dict[str, float]) -> list[tuple[int, int, float]]:
    """Maximal segments of a text, in word positions."""
    missing = cache.get
    values = np.empty(len(words))
    for i, word in enumerate(words):
        value = missing(word)
        if value is None:
            value = cache[word] = token_weight(word, weights)
        values[i] = value
    if not (values > 0).any():
        return []
    starts, short = compressed(values)
    ends = np.r_[starts[1:], len(words)]
    return [(int(starts[a]), int(ends[b - 1]), s) for a, b, s in segments(short)]


def bits_over_chance(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """Sum over segments of scale * score - log(n) - offset, where positive; the best one's value if none is."""
    if not found:
        return -10.0
    room = math.log(max(n, 50)) + model.offset
    values = [model.scale * s - room for _, _, s in found]
    over = [v for v in values if v > 0]
    return max(-10.0, sum(over) if over else max(values))


#: Words remembered with their weight; then the memory is emptied.
CACHE = 200_000


def scanned(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (columns id, body) with ``words``, ``excess`` (evidence) and passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(LETTERS).findall
        cache: dict[str, float] = {}
        for batch in batches:
            out = []
            for body in batch.column(1):
                if len(cache) > CACHE:
                    cache.clear()
                words = find(body.as_py().lower())
                found = passages(words, model.weights, cache)
                room = math.log(max(len(words), 50)) + model.offset
                sure = [(a, b, s) for a, b, s in found if model.scale * s > room]
                out.append((len(words), bits_over_chance(found, len(words), model), sure))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.float64()),
                    pa.array(
                        [[{"start": a, "end": b, "score": s} for a, b, s in o[2]] for o in out],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])),
                    ),
                ],
                names=["id", "words", "excess", "passages"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "body").mapInArrow(
        run, f"id {kind}, words long, excess double, passages array<struct<start:long,end:long,score:double>>"
    )


def chance_scale(share: float, weight: float) -> float:
    """The positive root of share * exp(x * weight) + (1 - share) * exp(x * OTHER) = 1."""
    low, high = 1e-6, 50.0 / max(weight, 1e-6)
    for _ in range(200):
        mid = (low + high) / 2
        if share * math.exp(mid * weight) + (1 - share) * math.exp(mid * OTHER) < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a little shrinkage."""
    basis = np.stack([np.ones_like(x), x], axis=1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ weights, -30, 30)))
        gradient = basis.T @ (y - p) - 0.01 * weights
        hessian = (basis * (p * (1 - p))[:, None]).T @ basis + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), float(max(weights[1], 1e-6))


def fit(labelled: DataFrame) -> Model:
    """A model from rows of ``id``, ``body`` and ``toxic`` (0 or 1), already bounded in number."""
    # Each row has a number of its own, as ids may repeat.
    labelled = labelled.filter("toxic is not null").select("body", "toxic")
    labelled = keep_table(labelled.withColumn("id", F.monotonically_increasing_id()))
    weights = learn_tokens(labelled)
    if not weights:
        return Model()
    # How often clean text meets a toxic token, and how much such a token weighs there.
    rates = scanned(labelled.filter("toxic = 0"), Model(weights, 1.0, 0.0)).agg(
        F.sum("words").alias("n"),
        F.sum(F.aggregate("passages", F.lit(0.0), lambda a, p: a + p["score"])).alias("s"),
        F.sum(F.size("passages")).alias("hits"),
    ).first()
    n, hits = float(rates["n"] or 0), float(rates["hits"] or 0)
    share = (hits + 1) / (n + 100)
    usual = float(np.median(list(weights.values())))
    model = Model(weights, chance_scale(min(share, 0.5 / (1 + usual)), usual), 0.0)
    pairs = scanned(labelled, model).select("id", "excess").join(labelled.select("id", "toxic"), "id")
    rows = pairs.select("excess", "toxic").collect()
    x, y = (np.array([float(r[i]) for r in rows]) for i in range(2))
    model.curve = logistic(np.clip(x, -10, 10), y) if len(set(y)) == 2 else model.curve
    return model


def labelled_rows(
    docs: DataFrame, labels: DataFrame, text: str, id_column: str, label: str, fit_rows: int
) -> DataFrame:
    """A bounded sample of labelled texts: the ``fit_rows`` labels with the least hash of their id.

    Rows of labels with a null id or label are left out; of several labels of one
    id the greatest holds, of several texts the one with the least hash, so there are no
    more texts than labels.
    """
    chosen = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(F.col(label)).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("body"))
    # At most fit_rows pairs of numbers are sent to every task.
    met = rows.join(F.broadcast(keep_table(chosen)), "id")
    return met.groupBy("id", "toxic").agg(F.min_by("body", F.struct(F.xxhash64("body"), "body")).alias("body"))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id``, ``score``, ``predicted`` and ``passages`` of every whole text.

    Passages are word positions, the end exclusive, of every segment whose score
    is beyond what chance gives in a clean text of that length. A null or empty
    text has none and gets the score of no evidence. Repeated rows get equal rows,
    null ids are kept, an empty table gives an empty result, other columns are not
    read. Without toxic training texts the model is empty and scores are low.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("body"))
    found = scanned(rows, model)
    start, slope = model.curve
    line = F.lit(start) + F.lit(slope) * F.least(F.greatest("excess", F.lit(-10.0)), F.lit(10.0))
    return found.withColumn("score", 1 / (1 + F.exp(-line))).select(
        "id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )
