"""Regression trees, forests and boosting for one series' training rows.

The grouped-map helpers of ``families`` call these on the matrix of one (series,
fold), which has at most as many rows as the calendar has months. All candidates
that differ only in their number of trees share one fit: the largest ensemble is
grown, and the smaller ones are its first trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)

#: Feature values nearer than this are not told apart by a cut.
NEAR = 1e-7
#: A node with less variance is a leaf.
PURE = np.finfo(float).eps
SEED = 42
#: Fixed settings of histogram boosting: least rows and most leaves of a tree.
HIST_LEAST_ROWS, HIST_LEAVES = 20, 31


@dataclass
class Tree:
    """Nodes in arrays: ``feature`` is -1 at a leaf; the children of a node are ``child`` and the next one.

    ``value`` is the mean of every node's rows, inner ones too, so a tree may be read down to any depth.
    """

    feature: list[int]
    cut: list[float]
    child: list[int]
    value: list[float]
    depth: int = 0

    def walk(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The value that each row of ``x`` reaches, at most ``depth`` levels below the root."""
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        at, rows, level = np.zeros(len(x), int), np.arange(len(x)), 0
        while depth is None or level < depth:
            inner = feature[at] >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, child[at] + right, at)
            level += 1
        return np.array(self.value)[at]


class Grower:
    """Grows trees on the rows of ``x``, whose columns are sorted once."""

    def __init__(self, x: np.ndarray, draw: np.random.RandomState | None = None) -> None:
        self.draw = draw
        self.x = np.ascontiguousarray(x.T, np.float32).astype(float)
        self.order = np.argsort(self.x, axis=1, kind="stable")
        self.values = np.take_along_axis(self.x, self.order, 1)

    def best_cut(
        self, values: np.ndarray, order: np.ndarray, y: np.ndarray, w: np.ndarray | None, least: int
    ) -> tuple | None:
        """``(gain, feature, cut)`` of the split that lowers the squared error most.

        ``values`` and ``order`` hold a node's rows in the order of each feature. Of splits that gain as
        much, the first feature's is taken, or with ``draw`` that of one drawn at random, as they predict
        differently.
        """
        m = order.shape[1]
        if m < 2 * least:
            return None
        if m == 2:
            return self._cut_two(values, order[0], y, w)
        if w is None:
            sums, n = y[order].cumsum(axis=1), float(m)
            n_left = np.arange(1.0, m)
        else:
            weights = w[order]
            sums, counts = (weights * y[order]).cumsum(axis=1), weights.cumsum(axis=1)
            n_left, n = counts[:, :-1], counts[:, -1:]
        left, total = sums[:, :-1], sums[:, -1:]
        right = total - left
        score = left * left / n_left + right * right / (n - n_left)
        score[values[:, 1:] - values[:, :-1] <= NEAR] = -np.inf
        if least > 1:
            score[:, : least - 1] = -np.inf
            score[:, m - least :] = -np.inf
        each = score.max(axis=1)
        if self.draw is None:
            f = int(each.argmax())
        else:
            features = self.draw.permutation(len(each))
            f = int(features[each[features].argmax()])
        if each[f] == -np.inf:
            return None
        i = int(score[f].argmax())
        low, high = float(values[f, i]), float(values[f, i + 1])
        cut = low / 2 + high / 2
        weight = n if w is None else n[f, 0]
        return each[f] - total[f, 0] ** 2 / weight, f, low if cut == high else cut

    def _cut_two(self, values: np.ndarray, rows: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> tuple | None:
        """Between two rows every feature that tells them apart gains as much."""
        apart = np.flatnonzero(values[:, 1] - values[:, 0] > NEAR)
        if not len(apart):
            return None
        f = int(apart[0] if self.draw is None else apart[self.draw.randint(len(apart))])
        a, b = (1.0, 1.0) if w is None else w[rows]
        low, high = float(values[f, 0]), float(values[f, 1])
        cut = low / 2 + high / 2
        return a * b / (a + b) * (y[rows[0]] - y[rows[1]]) ** 2, f, low if cut == high else cut

    def grow(
        self,
        y: np.ndarray,
        w: np.ndarray | None = None,
        depth: int | None = None,
        least: int = 1,
        leaves: int | None = None,
        gainful: bool = False,
    ) -> tuple[Tree, np.ndarray]:
        """A tree and the mean that each row reaches in it; rows of weight 0 take no part.

        With ``leaves`` the split that gains most comes first, until there are so many; with
        ``gainful`` only splits that lower the error are made.
        """
        values, order = self.values, self.order
        if w is not None and not w.all():
            drawn = (w > 0)[order]
            values, order = values[drawn].reshape(len(values), -1), order[drawn].reshape(len(order), -1)
        tree, reached, queue = Tree([], [], [], []), np.zeros(len(y)), []

        def add(values: np.ndarray, order: np.ndarray, level: int) -> None:
            node, rows = len(tree.feature), order[0]
            own = y[rows]
            if w is None:
                mean = float(own.sum()) / len(own)
                spread = float(np.dot(own - mean, own - mean)) / len(own) if len(own) > 1 else 0.0
            else:
                parts = w[rows]
                mean = float(np.dot(parts, own) / parts.sum())
                spread = float(np.dot(parts, (own - mean) ** 2) / parts.sum()) if len(own) > 1 else 0.0
            reached[rows] = mean
            tree.feature.append(-1)
            tree.cut.append(0.0)
            tree.child.append(0)
            tree.value.append(mean)
            if (depth is None or level < depth) and spread > PURE:
                found = self.best_cut(values, order, y, w, least)
                if found and (found[0] > 0 or not gainful):
                    heapq.heappush(queue, (-found[0] if leaves else node, node, level, values, order, found))

        add(values, order, 0)
        grown = 1
        while queue and (leaves is None or grown < leaves):
            _, node, level, values, order, (_, f, cut) = heapq.heappop(queue)
            tree.feature[node], tree.cut[node], tree.child[node] = f, cut, len(tree.feature)
            tree.depth = max(tree.depth, level + 1)
            stays = (self.x[f] <= cut)[order]
            # Both children are numbered in a row, so one place names them.
            for side in (stays, ~stays):
                add(values[side].reshape(len(values), -1), order[side].reshape(len(order), -1), level + 1)
            grown += 1
        return tree, reached


def shown(x: np.ndarray) -> np.ndarray:
    """Rows as trees see them."""
    return np.asarray(x, np.float32).astype(float)


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int | None = None) -> list[Tree]:
    """Trees on bootstrap samples; the first ones do not depend on how many follow."""
    grower, seeds = Grower(x, np.random.RandomState(SEED)), np.random.RandomState(SEED)
    grown = []
    for _ in range(trees):
        draw = np.random.RandomState(seeds.randint(np.iinfo(np.int32).max))
        counts = np.bincount(draw.randint(0, len(y), len(y)), minlength=len(y)).astype(float)
        grown.append(grower.grow(y, counts, depth)[0])
    return grown


def boosted(x: np.ndarray, y: np.ndarray, trees: int, rate: float, depth: int, histogram: bool) -> list[Tree]:
    """Each tree fits what the mean and the trees before it leave, at ``rate``.

    ``histogram`` keeps ``HIST_LEAST_ROWS`` in a leaf and grows ``HIST_LEAVES`` at most, best first.
    """
    options = {"least": HIST_LEAST_ROWS, "leaves": HIST_LEAVES, "gainful": True} if histogram else {}
    grower, rest, grown = Grower(x, None if histogram else np.random.RandomState(SEED)), y - y.mean(), []
    for _ in range(trees):
        tree, reached = grower.grow(rest, None, depth, **options)
        rest = rest - rate * reached
        grown.append(tree)
    return grown


def staged_forest(x, y, rows, sizes: Sequence[tuple[int, int | None]]) -> np.ndarray:
    """Predictions for ``rows`` of every (trees, depth), all from one forest of full depth."""
    depths = {d for _, d in sizes}
    grown = forest(x, y, max(n for n, _ in sizes), None if None in depths else max(depths))
    seen = shown(rows)
    sums = {d: np.cumsum([t.walk(seen, d) for t in grown], axis=0) for d in depths}
    return np.stack([sums[d][n - 1] / n for n, d in sizes])


def staged_boosting(x, y, rows, sizes: Sequence[int], rate: float, depth: int, histogram: bool) -> np.ndarray:
    """Predictions for ``rows`` after every number of trees in ``sizes``."""
    seen = shown(rows)
    steps = [rate * t.walk(seen) for t in boosted(x, y, max(sizes), rate, depth, histogram)]
    after = y.mean() + np.cumsum(steps, axis=0)
    return np.stack([after[n - 1] for n in sizes])
