"""Fill-in-the-middle: texts cut at two random units and put in another order.

A text is a list of units. An indexable skip list finds the code point of a unit's
rank: the lowest lane has every unit, each lane above a random part of the nodes
below, and each link carries how many units and how many code points it spans. A
search starts in the sparsest lane, follows links while their units still fit
the rank, goes down a lane, and sums the code points on its way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)

#: One node in this many also stands in the lane above, and a lane this short is the top.
FAN = 8
# The marks of prefix, suffix and middle, and of a hundred texts how many are
# rearranged and how many of those have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REARRANGED, SUFFIX_FIRST = 90, 20
#: Code points of output that a task gathers before it hands them on.
FLUSH = 4_000_000


class SkipList:
    """Links between unit boundaries; lanes from the lowest up.

    A lane is three arrays: the units and the code points that each link spans, and
    for each node its place in the lane below.
    """

    def __init__(self, points: np.ndarray, draw: np.random.Generator) -> None:
        """``points``: the code points of each unit."""
        units = np.broadcast_to(np.int64(1), len(points))
        self.lanes = [(units, points, None)]
        while len(units) > FAN:
            down = self._picked(len(units), draw)
            if len(down) < 2:
                break
            used = down[-1]
            units, points = (np.add.reduceat(width[:used], down[:-1]) for width in (units, points))
            self.lanes.append((units, points, down))

    @staticmethod
    def _picked(links: int, draw: np.random.Generator) -> np.ndarray:
        """Nodes of a lane that the lane above has, too: the first and a random part of the others."""
        places, last = [np.zeros(1, np.int64)], 0
        while last < links:
            more = last + np.cumsum(draw.geometric(1 / FAN, links // FAN + FAN))
            places.append(more)
            last = more[-1]
        every = np.concatenate(places)
        return every[every <= links]

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        node = units = points = 0
        for lane_units, lane_points, down in reversed(self.lanes):
            while node < len(lane_units) and units + lane_units[node] <= rank:
                units += int(lane_units[node])
                points += int(lane_points[node])
                node += 1
            if down is not None:
                node = int(down[node])
        return points


def unit_points(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of every unit: one each, or the matches of ``unit`` from left to right.

    What stands before a match belongs to its unit, and what follows the last match is a unit.
    """
    if unit is None:
        return np.broadcast_to(np.int64(1), len(text))
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], np.int64))


def rearranged(text: str, draws: tuple, unit: re.Pattern | None, draw: np.random.Generator) -> tuple:
    """``(units, form, prefix's and middle's code points, output)`` of one text."""
    first, second, choice, order = draws
    points = unit_points(text, unit)
    n = len(points)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or choice % 100 >= REARRANGED:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    lanes = SkipList(points, draw)
    start, end = lanes.points_before(low), lanes.points_before(high)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if order % 100 < SUFFIX_FIRST:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, start, end - start, output


def fill_in_middle(
    docs: DataFrame, unit: str | None = None, seed: int = 1, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``unit`` is a pattern of units; without it each code point is one. Cuts and form come
    from a digest of ``seed`` and id, so reruns agree, and rows with the same id share
    their draws. ``plain`` texts are left as they are, with null counts: empty and null
    ones, those that hold a mark, and one in ten. A null id draws as an empty one and is
    kept; repeated rows are kept; an empty table gives an empty result; other columns are
    not read. Texts are cut whole, whatever their length; a task holds one batch of rows.
    """
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, draw = re.compile(unit) if unit else None, np.random.default_rng(seed)
        for batch in batches:
            kinds = [batch.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            out, held = [], 0
            for row, key in enumerate(batch.column(0)):
                body = batch.column(1)[row].as_py()
                draws = tuple(batch.column(i)[row].as_py() for i in range(2, 6))
                out.append((key.as_py(), *rearranged(body, draws, pattern, draw)))
                held += len(body)
                if held > FLUSH or row == batch.num_rows - 1:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    out, held = [], 0
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text_or_empty(id_column)), 256)
    groups = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"), digest.alias("digest"))
    return rows.select("id", "text", *groups).mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text before it was rearranged.

    A mark has no beginning that is also its own or another mark's end, so the first
    mark found is the one put in.
    """

    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(one) + len(first) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, after, middle = split(PREFIX, SUFFIX)
    behind, front, centre = split(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, after))
        .when(form == "spm", F.concat(front, centre, behind))
        .otherwise(output)
    )
