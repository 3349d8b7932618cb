"""Ridge and elastic-net candidates, fitted per group of a panel.

Spark builds the groups, the folds and the feature arrays; the grouped-map
helpers of ``families`` call ``solve`` on one small system, all candidates of a
group together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)

# Fixed candidate grids.
RIDGE_GRID = {"alpha": (0.1, 1.0, 10.0, 100.0)}
ELASTIC_NET_GRID = {"alpha": (0.01, 0.05, 0.1, 0.5), "l1_ratio": (0.1, 0.3, 0.5, 0.7, 0.9)}
MAX_SWEEPS = 10_000
TOLERANCE = 1e-4
BLOCK = 32
#: Partitions of groups to be fitted, in units of the session's shuffle partitions.
GROUP_SPREAD = 4


@dataclass(frozen=True)
class Candidate:
    """A model family with its parameters."""

    family: str
    params: tuple[tuple[str, object], ...] = ()

    @property
    def label(self) -> str:
        return "_".join([self.family, *[f"{k}={v}" for k, v in self.params]])


def grid(family: str, values: dict[str, Sequence]) -> list[Candidate]:
    """One candidate per combination of parameter values."""
    names = list(values)
    return [Candidate(family, tuple(zip(names, combo))) for combo in product(*values.values())]


LINEAR_CANDIDATES = [*grid("ridge", RIDGE_GRID), *grid("elasticnet", ELASTIC_NET_GRID)]


def ridge_weights(gram: np.ndarray, moment: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Weights per alpha of min |y - xw|^2 + alpha |w|^2 from x'x and x'y of centred data."""
    eye = np.eye(len(moment))
    return np.stack([np.linalg.solve(gram + a * eye, moment) for a in alphas])


def elastic_net_weights(
    gram: np.ndarray, moment: np.ndarray, energy: float, l1: float, l2: float
) -> tuple[np.ndarray, bool]:
    """Weights of min |y - xw|^2 / 2 + l1 |w|_1 + l2 |w|^2 / 2 from x'x, x'y and y'y, and whether
    they came to rest within ``MAX_SWEEPS``.

    Cyclic coordinate descent from zero. It stops once the largest step is small
    against the largest weight and the duality gap is below the tolerance times
    y'y. While no weight changes sign a sweep is one fixed affine map, so sweeps
    are then taken in blocks by its powers, up to the first sign change or stop.
    """
    curve = np.diag(gram) + l2
    used = np.flatnonzero(np.diag(gram) > 0)
    weights, fitted = np.zeros(len(moment)), np.zeros(len(moment))
    sweeps = 0
    while sweeps < MAX_SWEEPS:
        before = weights.copy()
        for j in used:
            pull = moment[j] - fitted[j] + gram[j, j] * weights[j]
            new = math.copysign(max(abs(pull) - l1, 0.0), pull) / curve[j]
            if new != weights[j]:
                fitted += (new - weights[j]) * gram[j]
                weights[j] = new
        sweeps += 1
        if stops(before[None], weights[None], gram, moment, energy, l1, l2)[0]:
            return weights, True
        signs = np.sign(weights)
        if not np.array_equal(signs, np.sign(before)):
            continue
        block = sweep_block(gram, moment, l1, curve, signs)
        while sweeps < MAX_SWEEPS:
            ahead = block(weights)[: MAX_SWEEPS - sweeps]
            starts = np.vstack([weights, ahead[:-1]])
            pulls = moment - ahead @ np.tril(gram, -1).T - starts @ np.triu(gram, 1).T
            turned = (np.sign(ahead) != signs).any(axis=1)
            turned |= (np.abs(pulls[:, signs == 0]) > l1).any(axis=1)
            stopped = ~turned & stops(starts, ahead, gram, moment, energy, l1, l2)
            event = np.flatnonzero(turned | stopped)
            if event.size and stopped[event[0]]:
                return ahead[event[0]], True
            good = event[0] if event.size else len(ahead)
            if good:
                weights = ahead[good - 1].copy()
                sweeps += good
            if event.size:
                break
        fitted = gram @ weights
    return weights, False


def sweep_block(gram, moment, l1, curve, signs):
    """Function from weights to the next BLOCK sweeps, for fixed signs."""
    on = np.flatnonzero(signs)
    inner = gram[np.ix_(on, on)]
    solver = np.linalg.inv(np.diag(curve[on]) + np.tril(inner, -1))
    step, shift = -solver @ np.triu(inner, 1), solver @ (moment[on] - l1 * signs[on])
    powers, shifts = [step], [shift]
    for _ in range(BLOCK - 1):
        powers.append(step @ powers[-1])
        shifts.append(step @ shifts[-1] + shift)
    stacked, offsets = np.concatenate(powers), np.concatenate(shifts)

    def advance(weights: np.ndarray) -> np.ndarray:
        ahead = np.zeros((BLOCK, len(weights)))
        ahead[:, on] = (stacked @ weights[on] + offsets).reshape(BLOCK, len(on))
        return ahead

    return advance


def stops(before, after, gram, moment, energy, l1, l2) -> np.ndarray:
    """Whether each sweep (rows of before and after) meets the stopping rule."""
    small = np.abs(after - before).max(axis=1) <= TOLERANCE * np.abs(after).max(axis=1)
    if not small.any():
        return small
    fitted = after @ gram
    agreement = energy - after @ moment
    residual = agreement - after @ moment + np.einsum("sp,sp->s", after, fitted)
    size = np.einsum("sp,sp->s", after, after)
    slack = np.abs(moment - fitted - l2 * after).max(axis=1)
    shrink = np.where(slack > l1, l1 / np.where(slack > 0, slack, 1.0), 1.0)
    primal = residual / 2 + l1 * np.abs(after).sum(axis=1) + l2 * size / 2
    dual = shrink * agreement - shrink**2 * residual / 2 - l2 * shrink**2 * size / 2
    return small & (primal - dual < TOLERANCE * energy)


@dataclass
class Moments:
    """What a linear fit needs of its training rows: their number, the features' means, products
    around them (``gram``) and with the target (``moment``), and the target's ``level`` and squares
    around it (``energy``)."""

    rows: int
    centre: np.ndarray
    gram: np.ndarray
    moment: np.ndarray
    level: float
    energy: float


def moments_of(x: np.ndarray, y: np.ndarray) -> Moments:
    centre, level = x.mean(axis=0), y.mean()
    xc, yc = x - centre, y - level
    return Moments(len(y), centre, xc.T @ xc, xc.T @ yc, float(level), float(yc @ yc))


def solve_moments(m: Moments, candidates: Sequence[Candidate]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts and weights of every candidate, and whether they converged."""
    weights, converged = np.zeros((len(candidates), len(m.moment))), np.ones(len(candidates), bool)
    params = [dict(c.params) for c in candidates]
    ridge = [i for i, c in enumerate(candidates) if c.family == "ridge"]
    if ridge:
        weights[ridge] = ridge_weights(m.gram, m.moment, np.array([params[i]["alpha"] for i in ridge]))
    for i in (i for i, c in enumerate(candidates) if c.family == "elasticnet"):
        penalty, ratio = params[i]["alpha"] * m.rows, params[i]["l1_ratio"]
        weights[i], converged[i] = elastic_net_weights(
            m.gram, m.moment, m.energy, penalty * ratio, penalty * (1 - ratio)
        )
    return m.level - weights @ m.centre, weights, converged


def solve(
    x: np.ndarray, y: np.ndarray, candidates: Sequence[Candidate]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts and weights of every candidate on one training set, and whether they converged."""
    return solve_moments(moments_of(x, y), candidates)


def spread_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash the groups over a fixed number of partitions.

    Fitting costs far more than its input's size suggests; left to size alone,
    adaptive execution would merge the small partitions into a few tasks.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(GROUP_SPREAD * count, *keys)


def linear_prediction() -> Column:
    """Dot product of the ``features`` and ``weights`` arrays plus the intercept."""
    products = F.zip_with("features", "weights", lambda a, b: a * b)
    return F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
