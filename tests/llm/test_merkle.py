from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def joined(parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests):
    """The root and each leaf's siblings, level by level."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for leaf, node in enumerate(at):
            run = level[node // 3 * 3 : node // 3 * 3 + 3]
            proofs[leaf].append(("".join(run[: node % 3]), "".join(run[node % 3 + 1 :])))
        level = [joined(level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [node // 3 for node in at]
    return level[0], proofs


def brute_manifest(rows):
    """(id, leaf, subroot, root, left, right) of (source, id, leaf)."""
    order = lambda s: (s is not None, (s or "").encode())
    trees = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in {r[0] for r in rows}}
    names = sorted(trees, key=order)
    built = {s: brute_tree([r[2] for r in trees[s]]) for s in names}
    root, above = brute_tree([built[s][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for (_, key, leaf), proof in zip(trees[s], built[s][1]):
            whole = proof + above[place]
            out.append((key, leaf, built[s][0], root, [p[0] for p in whole], [p[1] for p in whole]))
    return sorted(out, key=repr)


SCHEMA = "source string, id long, leaf string"


def found(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return merkle.build_manifest(df, "source", "id", "leaf", extra)


def rows_of(sizes, seed=1):
    draw = random.Random(seed)
    rows = [(s, i, joined([f"{s}{i}"])) for s, n in sizes.items() for i in range(n)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_matches_brute_force(spark, monkeypatch, levels):
    """Spans of a few leaves make several rounds; sizes around the powers of three make short last runs."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", 3**levels)
    rows = rows_of({None: 5, "": 1, "a": 81, "b": 82, "é": 28, "z": 3, "zz": 10, "big": 244})
    got = sorted((tuple(r) for r in found(spark, rows).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_one_source_and_one_row(spark):
    rows = rows_of({"only": 7})
    assert sorted((tuple(r) for r in found(spark, rows).collect()), key=repr) == brute_manifest(rows)
    (row,) = found(spark, [("s", 4, "x")]).collect()
    assert tuple(row) == (4, "x", "x", "x", [], [])


def test_repeated_rows_and_null_ids(spark):
    rows = rows_of({"a": 20, None: 4}) + [("a", 3, "same")] * 30 + [("a", None, "same")] * 2 + [(None, None, "q")]
    assert sorted((tuple(r) for r in found(spark, rows).collect()), key=repr) == brute_manifest(rows)


def test_empty_table(spark):
    assert found(spark, []).count() == 0


def test_folding_shows_a_changed_leaf(spark):
    rows = rows_of({"a": 40, "b": 2, "c": 9, "d": 1})
    done = found(spark, rows)
    other = F.when(F.col("id") % 2 == 0, F.concat("leaf", F.lit("!"))).otherwise(F.col("leaf"))
    got = done.select("id", "root", merkle.folded(other).alias("folded"), merkle.proof_digest().alias("proof"), "left", "right").collect()
    assert all((r.folded == r.root) == (r.id % 2 == 1) for r in got)
    assert all(r.proof == joined([a + b for a, b in zip(r.left, r.right)]) for r in got)


def test_sweeps_of_every_size():
    for n in range(1, 60):
        digests = [joined([str(i)]) for i in range(n)]
        root, proofs = brute_tree(digests)
        top, log = merkle.sweep_up(digests, merkle.height_of(n))
        assert top == root
        sides = merkle.sweep_down(log, n, [], [])
        assert [list(zip(*s)) for s in sides] == proofs


def test_leaf_digest(spark):
    df = spark.createDataFrame([(1, "é\n", None), (None, "", 2.5)], "a long, b string, c double")
    got = [r.d for r in df.select(merkle.leaf_digest([F.col("a"), F.col("b"), F.col("c")]).alias("d")).collect()]
    assert got == [joined(["1:1", "3:é\n", "-"]), joined(["-", "0:", "3:2.5"])]


def test_carried_columns_and_clashing_names(spark):
    rows = rows_of({"a": 5, "b": 4})
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mine", F.col("id") * 2).withColumn("tree", F.lit("own"))
    got = merkle.build_manifest(df, "source", "id", "leaf", ["mine"]).collect()
    assert all(r.mine == r.id * 2 for r in got) and len(got) == 9
    with pytest.raises(ValueError, match="carried column"):
        merkle.build_manifest(df, "source", "id", "leaf", ["tree"])
