"""A Merkle manifest of a table: a tree of digests per source, and a tree over their roots.

Digests travel by time-forward processing. Nodes are labelled in the order in which
their last leaf ends; a node sends its digest to its parent's label through a priority
queue, so when the sweep reaches a label, the digests of all children lie at the queue's
front. A second sweep, in reversed order, sends each node's proof to its children, who
put their own siblings in front.

The queue is external. Every span of consecutive leaves is a subtree whose messages stay
inside, in a heap of one task; a message to a label beyond the span is a row of a table
that Spark sorts by label, spilling if it must, and whose spans are swept in turn. So a
source of any size is worked on by as many tasks as it has spans, and no task holds more
than one of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.numbering import number_rows
from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

#: Children of a node, and levels that one task sweeps at once.
FAN = 3
LEVELS = 7
SPAN = FAN**LEVELS


def joined_digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height_of(nodes: int) -> int:
    """Levels above ``nodes`` nodes, up to the one where a single node is left."""
    height = 0
    while FAN**height < nodes:
        height += 1
    return height


def sweep_up(digests: Sequence[str], height: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The digest ``height`` levels above, and ``(level, index, children)`` in label order.

    The queue holds less than one run of each level at any time.
    """
    queue: list[tuple[int, int, int, int, str]] = []
    log: list[tuple[int, int, list[str]]] = []
    n, top = len(digests), digests[0]

    def send(level: int, index: int, digest: str) -> None:
        parent = index // FAN
        heapq.heappush(queue, (min((parent + 1) * FAN ** (level + 1), n), level + 1, parent, index, digest))

    for index, leaf in enumerate(digests if height else ()):
        send(0, index, leaf)
        while queue and queue[0][0] == index + 1:
            label, children = queue[0][:3], []
            while queue and queue[0][:3] == label:
                children.append(heapq.heappop(queue)[4])
            _, level, parent = label
            log.append((level, parent, children))
            top = joined_digest(children)
            if level < height:
                send(level, parent, top)
    return top, log


def sweep_down(log: list, n: int, left: list[str], right: list[str]) -> list[tuple[list[str], list[str]]]:
    """For each of ``n`` nodes the siblings to its left and right, level by level, ending in the given ones."""
    if not log:
        return [(left, right)] * n
    queue: list[tuple[int, int, int, list[str], list[str]]] = []
    proofs: list = [None] * n
    first, above = log[-1], (left, right)
    for level, index, children in reversed(log):
        if (level, index) != first[:2]:
            above = heapq.heappop(queue)[3:]
        for place, _ in enumerate(children):
            child = index * FAN + place
            siblings = "".join(children[:place]), "".join(children[place + 1 :])
            proof = [siblings[0], *above[0]], [siblings[1], *above[1]]
            if level == 1:
                proofs[child] = proof
            else:
                end = min((child + 1) * FAN ** (level - 1), n)
                heapq.heappush(queue, (-end, 1 - level, child, *proof))
    return proofs


def _spans(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes dealt by span, each span's in order."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", "span", "index"]
    return nodes.repartition(partitions, "tree", "span").sortWithinPartitions(*by).select(*by, "n", "digest", *more)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one span after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["tree"], held[0]["span"]) != (row["tree"], row["span"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _with_span(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("span", F.floor(F.col("index") / SPAN).cast("long"))


def raised(nodes: DataFrame) -> DataFrame:
    """Each span's top as a node ``(tree, n, index, digest)`` of the next, smaller table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _runs(batches):
            n = rows[0]["n"]
            top, _ = sweep_up([r["digest"] for r in rows], LEVELS if n > SPAN else height_of(n))
            out.append((rows[0]["tree"], -(-n // SPAN), rows[0]["span"], top))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["tree", "n", "index", "digest"])

    return _spans(_with_span(nodes)).mapInArrow(run, "tree string, n long, index long, digest string")


def lowered(nodes: DataFrame, proofs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``(tree, index, digest, left, right, top)`` and the ``carry`` columns of every node.

    ``proofs`` has ``(tree, span, left, right, top)``, one row for each span. It travels to
    its span as one more row ahead of the nodes.
    """
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in carry}
    sent = proofs.select("tree", "span", "left", "right", "top").withColumns(
        {"index": F.lit(-1).cast("long"), "n": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")}
        | {c: F.lit(None).cast(kinds[c]) for c in carry}
    )
    wide = {"left": "array<string>", "right": "array<string>", "top": "string"}
    both = _with_span(nodes).withColumns({c: F.lit(None).cast(k) for c, k in wide.items()}).unionByName(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches):
            n = rows[0]["n"]
            digests = [r["digest"] for r in rows]
            _, log = sweep_up(digests, LEVELS if n > SPAN else height_of(n))
            sides = sweep_down(log, len(rows), head["left"], head["right"])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([head["tree"]] * len(rows), pa.string()),
                    pa.array([r["index"] for r in rows], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([s[0] for s in sides], strings),
                    pa.array([s[1] for s in sides], strings),
                    pa.array([head["top"]] * len(rows), pa.string()),
                    *[pa.array([r[c] for r in rows], types[c]) for c in carry],
                ],
                names=["tree", "index", "digest", "left", "right", "top", *carry],
            )

    types = {c: _arrow_type(nodes, c) for c in carry}
    schema = "tree string, index long, digest string, left array<string>, right array<string>, top string"
    for c in carry:
        schema += f", `{c}` {kinds[c]}"
    return _spans(both, *wide, *carry).mapInArrow(run, schema)


def _arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables of every round, and each tree's root with the round that reached it."""
    rounds, roots = [nodes], None
    while True:
        tops = keep_table(raised(rounds[-1]))
        done = tops.filter("n = 1").select("tree", "digest", F.lit(len(rounds) - 1).alias("round"))
        roots = done if roots is None else roots.union(done)
        still = tops.filter("n > 1")
        if still.isEmpty():
            return rounds, roots
        rounds.append(still)


def _descend(rounds: list[DataFrame], roots: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Proofs of the first round's nodes from those of the roots, ``(tree, round, left, right, top)``."""
    below = None
    for at in reversed(range(len(rounds))):
        proofs = roots.filter(F.col("round") == at).withColumn("span", F.lit(0).cast("long")).drop("round")
        if below is not None:
            proofs = proofs.unionByName(below.select("tree", F.col("index").alias("span"), "left", "right", "top"))
        below = lowered(rounds[at], proofs, carry if at == 0 else ())
        if at:
            below = keep_table(below)
    return below


def build_manifest(
    leaves: DataFrame, group: str, order: str, digest: str, carry: Sequence[str] = ()
) -> DataFrame:
    """The ``order`` column, ``leaf``, ``subroot``, ``root``, ``left``, ``right`` and ``carry`` columns of every row.

    The leaves of a group ascend by ``order``, nulls first, rows with the same one by their
    digest. While several nodes remain, every three in turn become the digest of their
    digests, the last run being shorter; a single leaf is its own root. The roots of the
    groups, ordered by the bytes of the group's name with null first, are combined
    likewise. ``left`` and ``right`` hold, for each level from the leaf to the root, the
    joined digests of the siblings before and after. Repeated rows are leaves of their own.
    An empty table gives an empty result.
    """
    names = [order, *carry]
    if not {*names}.isdisjoint({"tree", "n", "index", "digest", "left", "right", "top", "span", "of_tree"}):
        raise ValueError("a carried column has the name of a column of the tree")
    known = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = keep_table(leaves.select(known.alias("tree"), F.col(digest).alias("digest"), *names))
    numbered = number_rows(rows, [order, "digest", *carry], "tree")
    sizes = rows.groupBy(F.col("tree").alias("of_tree")).agg(F.count("*").alias("n"))
    nodes = keep_table(numbered.join(sizes, F.col("tree") == F.col("of_tree")).drop("of_tree"))
    rounds, roots = _climb(nodes)
    roots = keep_table(roots)
    # The tree over the roots is one more tree; its leaves carry their own tree's name.
    over = roots.select(F.lit("roots").alias("tree"), "digest", F.col("tree").alias("name"), "round")
    count = over.count()
    over = keep_table(number_rows(over, ["name"]).withColumn("n", F.lit(count).cast("long")))
    above, tops = _climb(over)
    root = tops.select(F.col("digest").alias("top"), "tree", "round")
    nothing = F.array().cast("array<string>")
    root = root.withColumns({"left": nothing, "right": nothing})
    of_roots = _descend(above, root, ("name", "round"))
    seeds = keep_table(
        of_roots.select(
            F.col("name").alias("tree"), "round", "left", "right",
            # A span passes one text down; it holds the source's and the whole root.
            F.concat_ws(" ", "digest", "top").alias("top"),
        )
    )
    found = _descend(rounds, seeds, names)
    ends = F.split("top", " ")
    return found.select(
        *[F.col(f"`{c}`") for c in [order]],
        F.col("digest").alias("leaf"),
        F.get(ends, F.lit(0)).alias("subroot"),
        F.get(ends, F.lit(1)).alias("root"),
        "left",
        "right",
        *[F.col(f"`{c}`") for c in carry],
    )


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of the columns' values in turn: ``-`` if null, else UTF-8 byte count, ``:`` and value."""

    def packed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[packed(c) for c in columns]), 256)


def proof_digest() -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), ""), 256)


def folded(leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(
        F.arrays_zip("left", "right"), leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256)
    )
