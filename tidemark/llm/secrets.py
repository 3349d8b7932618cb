"""Secret scan: strong patterns, and weak parts linked across a scope.

Strong spans (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak parts are not evidence alone: an account name (``ident``), an opaque
mixed token (``opaque``) or an address (``endpoint``). They are reported only
when a complementary part lies within ``scope`` characters: a name needs a
secret, an opaque token needs a name or an address, an address needs both a name
and a secret.

The link is an interval join on cells of the text: every part posts the least
and greatest start and end to its cell, weak parts probe the cells that their
scope can reach. Both sides are linear in the number of parts; no pairs are
listed, so a text with a million parts costs a million rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_sized, text_or_empty
from tidemark.session import keep_table


@dataclass(frozen=True)
class Kind:
    """A pattern: the group that must reach ``least`` characters, and the part's role."""

    name: str
    pattern: str
    group: int
    least: int
    role: str


# The strong kinds, in the order of their rank.
STRONG = (
    Kind(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        "secret",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "ident"),
    # Runs are taken whole, so asking for the length in the pattern drops the same ones.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret"),
)
SCHEME = r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]++://"
WEAK = (
    Kind(
        "ident",
        r"\b([Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]"
        r"|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]+)",
        2,
        3,
        "ident",
    ),
    # A run with a letter and a digit, wherever in it they stand; each run is looked at once, at its start.
    Kind(
        "opaque",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}",
        0,
        16,
        "secret",
    ),
    Kind("endpoint", SCHEME + r"[^\x20\x09-\x0D\"'<>]+", 0, 8, "endpoint"),
    # Name, secret and endpoint in one: the parts complete each other, so it is always reported.
    Kind(
        "login", SCHEME + r"[^\x20\x09-\x0D\"'<>:/@]+:[^\x20\x09-\x0D\"'<>/@]+@[^\x20\x09-\x0D\"'<>]+", 0, 8, "login"
    ),
)
KINDS = STRONG + WEAK
ROLES = ("ident", "secret", "endpoint")
#: Matches whose lengths are summed at once when positions are worked out.
SUM_BLOCK = 256


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, kind: Kind, rank: int) -> Column:
    """Spans ``(start, rank, end)`` of one kind, leftmost and not overlapping.

    Starts are code points. The text between matches comes from ``split``; a
    match starts after all texts and matches before it. These sums are taken by
    blocks, so a text with many matches stays far from quadratic.
    """
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    sizes = F.transform(found, lambda m: F.length(m))
    steps = F.zip_with(
        F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p)), sizes, lambda p, m: p + F.coalesce(m, F.lit(0))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), (F.size(found) / SUM_BLOCK).cast("int")),
        lambda b: total(F.slice(steps, b * SUM_BLOCK + 1, SUM_BLOCK)),
    )
    before = F.transform(
        F.sequence(F.lit(0), (F.size(found) / SUM_BLOCK).cast("int")), lambda b: total(F.slice(blocks, F.lit(1), b))
    )
    packed = F.struct(found.alias("found"), measured.alias("measured"), steps.alias("steps"), before.alias("before"))

    def spans(p: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = (i / SUM_BLOCK).cast("int")
            end = F.get(p["before"], block) + total(
                F.slice(p["steps"], block * SUM_BLOCK + 1, i % SUM_BLOCK + 1)
            )
            return F.struct(
                (end - F.length(m)).alias("start"),
                F.lit(rank).alias("rank"),
                end.alias("end"),
                (F.length(F.get(p["measured"], i)) >= kind.least).alias("long"),
            )

        kept = F.filter(F.transform(p["found"], one), lambda s: s["long"])
        return F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["end"]))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    # A one-element array binds the intermediate arrays once.
    return F.when(
        F.regexp_like(text, pattern), F.flatten(F.transform(F.array(packed), spans))
    ).otherwise(none)


def strong_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` and sorted arrays: ``base`` (strong spans), ``weak`` (free weak parts), ``touched``
    (endpoints that a strong span overlaps, evidence for their neighbours) and ``logins``."""
    for rank, kind in enumerate(KINDS):
        docs = docs.withColumn(f"_{kind.name}", matches(text, kind, rank))
    base = F.sort_array(F.concat(*[F.col(f"_{k.name}") for k in STRONG]))
    loose = F.sort_array(F.concat(*[F.col(f"_{k.name}") for k in WEAK if k.role in ROLES]))
    docs = docs.withColumn("base", base).withColumn("loose", loose).withColumn("logins", F.col("_login"))
    meets = lambda w: F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    free = F.when(F.size("loose") == 0, F.col("loose")).otherwise(F.filter("loose", lambda w: ~meets(w)))
    docs = docs.withColumns({"weak": free, "touched": F.filter("_endpoint", meets)})
    return docs.drop("loose", *[f"_{k.name}" for k in KINDS])


def role_of(rank: Column) -> Column:
    names = F.array(*[F.lit(k.role) for k in KINDS])
    return F.get(names, rank)


def linked_parts(found: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """Weak parts with complementary parts in reach, as ``keys`` and an array ``linked``.

    Rows of equal keys hold the same text, so their parts count once.
    """
    told = [("base", False), ("weak", True), ("touched", False)]
    every = F.concat(*[F.arrays_zip(F.col(c).alias("part"), F.array_repeat(F.lit(o), F.size(c)).alias("own")) for c, o in told])
    parts = found.filter(F.size("weak") > 0).select(*keys, F.explode(every).alias("at"))
    parts = parts.select(*keys, "at.part.*", "at.own").withColumn("role", role_of(F.col("rank")))
    cell = lambda at: F.floor(at / scope)
    posts = parts.select(
        *keys, "role", F.explode(F.array(
            F.struct(cell(F.col("start")).alias("cell"), F.col("start").alias("s"), F.lit(None).cast("int").alias("e")),
            F.struct(cell(F.col("end")).alias("cell"), F.lit(None).cast("int").alias("s"), F.col("end").alias("e")),
        )).alias("at"),
    ).select(*keys, "role", "at.*")
    bounds = [
        f(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{n}")
        for role in ROLES
        for n, f, c in (("first", F.min, "s"), ("last", F.max, "s"), ("first_end", F.min, "e"), ("last_end", F.max, "e"))
    ]
    cells = posts.groupBy(*keys, "cell").agg(*bounds)

    weak = parts.filter("own")
    reach = F.array(
        F.struct(cell(F.col("start")).alias("cell"), F.lit(0).alias("side")),
        F.struct((cell(F.col("start")) - 1).alias("cell"), F.lit(1).alias("side")),
        F.struct(cell(F.col("end")).alias("cell"), F.lit(2).alias("side")),
        F.struct((cell(F.col("end")) + 1).alias("cell"), F.lit(3).alias("side")),
    )
    probes = weak.select(*keys, "start", "rank", "end", F.explode(reach).alias("at")).select(
        *keys, "start", "rank", "end", "at.*"
    )
    # Keys may be null.
    cells = cells.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "cell")], *[b for b in cells.columns if b not in (*keys, "cell")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "cell")])
    held = probes.join(cells, same)

    def near(role: str) -> Column:
        hit = (
            F.when(F.col("side") == 0, F.col(f"{role}_first_end") <= F.col("start"))
            .when(F.col("side") == 1, F.col(f"{role}_last_end") >= F.col("start") - scope)
            .when(F.col("side") == 2, F.col(f"{role}_last") >= F.col("end"))
            .otherwise(F.col(f"{role}_first") <= F.col("end") + scope)
        )
        return F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"near_{role}")

    judged = held.groupBy(*keys, "start", "rank", "end").agg(*[near(r) for r in ROLES])
    role = role_of(F.col("rank"))
    complete = (
        F.when(role == "ident", F.col("near_secret"))
        .when(role == "secret", F.col("near_ident") | F.col("near_endpoint"))
        .otherwise(F.col("near_ident") & F.col("near_secret"))
    )
    spans = F.sort_array(F.collect_set(F.struct("start", "rank", "end")))
    return judged.filter(complete).groupBy(*keys).agg(spans.alias("linked"))


def scan_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id", scope: int = 200) -> DataFrame:
    """The id, strong spans ``base`` and all ``spans`` of every whole text.

    A span is ``(start, rank, end)`` in code points, the end exclusive; the rank
    points into ``KINDS``. A null text counts as empty and has no spans. Every
    row gives one row; repeated rows give equal rows; null ids are kept. An empty
    table gives an empty result, and other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("body"))
    found = strong_spans(rows.withColumn("mark", F.xxhash64("body")), F.col("body")).drop("body")
    found = keep_table(found)
    # The linked parts of one text are one row: at most as many as its weak parts.
    links = keep_sized(
        linked_parts(found, ["id", "mark"], scope).select(
            F.col("id").alias("link_id"), F.col("mark").alias("link_mark"), "linked"
        )
    )
    joined = found.join(links, F.col("id").eqNullSafe(F.col("link_id")) & (F.col("mark") == F.col("link_mark")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    every = F.sort_array(F.concat("base", F.coalesce("linked", none), "logins"))
    return joined.select("id", "mark", "base", every.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column, label: str = "[secret]") -> Column:
    """The text with every maximal run of overlapping spans replaced by a label.

    ``spans`` are sorted by start.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(a["out"], F.array(piece, F.lit(label)))).otherwise(a["out"]).alias("out"),
        )

    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))


def redact_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id", scope: int = 200) -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced by a label.

    A null text stays null. Rows without any span keep their text unchanged.
    """
    spans = scan_secrets(docs, text, id_column, scope).filter(F.size("spans") > 0).select(
        F.col("id").alias("_span_id"), F.col("mark").alias("_span_mark"), "spans"
    )
    spans = keep_sized(spans.dropDuplicates(["_span_id", "_span_mark"]).withColumnRenamed("spans", "_spans"))
    packed = docs.select(
        F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_mark")
    )
    joined = packed.join(
        spans, F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_mark") == F.col("_span_mark")), "left"
    )
    body = F.col(f"_row.`{text}`")
    cleaned = F.when(F.col("_spans").isNotNull(), redact(body, F.col("_spans"))).otherwise(body)
    return joined.select(*[
        (cleaned if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns
    ])
