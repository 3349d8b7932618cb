"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text is
normalised, cut into blocks of words and the distinct words of each block encoded
with every dictionary; the language with the fewest bytes in sum wins. Blocks and
distinct words keep a long or repetitive text from becoming its own dictionary. A
text whose margin to the runner-up is narrow is rejected.

Dictionaries have one length and one set of compression parameters, since sizes are
compared between them; a language with little sample text keeps its shorter one and
costs the others nothing. Sample pieces that the other half of the sample
takes for another language, such as quoted passages, are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep_sized, text_or_empty
from tidemark.session import ship_with_tasks

ship_with_tasks(__name__)

UNKNOWN = "und"
#: Words of a block that is encoded at once.
BLOCK = 512
#: Fewest bytes of a dictionary (the format's), and times that the sample is cleaned.
LEAST_DICTIONARY = 8
#: Dictionaries of at least this share of the longest one are cut to one length.
COMPARABLE = 0.5
CLEANINGS = 2
#: Bytes of difference that make a language e times less likely.
SCALE = 4.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def normal(text: str) -> str:
    """Lower-cased words, one space between them; empty if the text has no letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return words if any(map(str.isalpha, words)) else ""


def parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY,
        window_log=19,
        hash_log=17,
        chain_log=17,
        search_log=4,
        min_match=4,
        target_length=16,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def blocks_of(words: list[str]) -> list[bytes]:
    return [
        " ".join(dict.fromkeys(words[i : i + BLOCK])).encode("utf-8", "surrogatepass")
        for i in range(0, len(words), BLOCK)
    ]


def fit_dictionaries(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id_column: str = "doc_id",
    rows_per_language: int = 1000,
    chars_per_row: int = 200,
) -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of labelled rows.

    The sample takes the ``rows_per_language`` rows with the least hash of their id and
    text, and from each ``chars_per_row`` characters around its middle. Rows with a null
    language or text teach nothing; equal pieces count once. What reaches the driver
    is at most the number of languages times both bounds.
    """
    usable = docs.filter(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0))
    start = F.greatest(F.lit(1), ((F.length(F.col(text)) - chars_per_row) / 2).cast("int"))
    drawn = usable.select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(id_column), F.col(text), F.lit("sample")).alias("draw"),
        F.substring(F.col(text), start, F.lit(chars_per_row)).alias("piece"),
    )
    # Draws are evenly spread, so a language's least ones lie below a line that follows
    # from its number of rows: four times as many as needed are ranked, not all.
    # At most one row per language.
    sizes = docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("rows"))
    line = F.lit(4.0 * rows_per_language) / F.col("rows")
    low = (F.col("draw").cast("double") / 2.0**64 + 0.5) < line
    drawn = drawn.join(keep_sized(sizes), "lang").filter(low)
    first = Window.partitionBy("lang").orderBy("draw", "piece")
    chosen = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows_per_language)
    sample: dict[str, dict[str, None]] = {}
    for row in chosen.orderBy("lang", "n").collect():
        piece = normal(row["piece"])
        if piece:
            sample.setdefault(row["lang"], {})[piece] = None
    pieces = {name: list(found) for name, found in sample.items()}
    kept = {name: list(range(len(p))) for name, p in pieces.items()}
    for _ in range(CLEANINGS):
        kept = cleaned(pieces, kept)
    joined = {name: " ".join(pieces[name][i] for i in kept[name]).encode("utf-8", "surrogatepass") for name in kept}
    return levelled({name: c for name, c in sorted(joined.items()) if len(c) >= LEAST_DICTIONARY})


def levelled(contents: dict[str, bytes]) -> dict[str, bytes]:
    """Contents of comparable length cut to the shortest of them; scarce ones as they are."""
    most = max(map(len, contents.values()), default=0)
    cut = min((len(c) for c in contents.values() if len(c) >= COMPARABLE * most), default=0)
    return {name: c[:cut] for name, c in contents.items()}


def cleaned(pieces: dict[str, list[str]], kept: dict[str, list[int]]) -> dict[str, list[int]]:
    """Numbers of the pieces whose language the kept pieces of the other half recognise."""
    out: dict[str, list[int]] = {name: [] for name in pieces}
    for half in (0, 1):
        content = {
            name: " ".join(pieces[name][i] for i in kept[name] if i % 2 == half).encode("utf-8", "surrogatepass")
            for name in pieces
        }
        content = {name: c for name, c in content.items() if len(c) >= LEAST_DICTIONARY}
        encoders = Encoders(levelled(content))
        for name in pieces:
            for i in range(1 - half, len(pieces[name]), 2):
                if name not in content or encoders.judge(pieces[name][i])[0] == name:
                    out[name].append(i)
    return {name: sorted(found) for name, found in out.items()}


class Encoders:
    """One compressor per language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.compressors, options = [], parameters()
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=options)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=options))

    def sizes(self, text: str) -> list[int] | None:
        """Encoded bytes of the whole text in each language; None without letters."""
        blocks = blocks_of(normal(text).split())
        if not blocks or not self.names:
            return None
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def judge(self, text: str) -> tuple[str, float, int, float]:
        """Language, score, and the bytes and the share that the runner-up needs more."""
        sizes = self.sizes(text)
        if sizes is None:
            return UNKNOWN, 0.0, 0, 0.0
        ranked = sorted(zip(sizes, self.names))
        best, name = ranked[0]
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / SCALE)) for s in sizes)
        next_size = ranked[1][0] if len(ranked) > 1 else 2 * best
        return name, score, next_size - best, (next_size - best) / next_size


def identify_language(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    id_column: str = "doc_id",
    least_bytes: int = 2,
    least_margin: float = 0.01,
) -> DataFrame:
    """``id``, ``lang_pred``, ``score``, ``bytes_over``, ``margin`` and ``rejected`` of every whole text.

    ``lang_pred`` is the language of the smallest encoding, of equal ones the first
    by name; ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned. ``rejected`` marks ``und`` and narrow margins: a
    runner-up that needs fewer than ``least_bytes`` or ``least_margin`` of its size more. Repeated
    rows get equal rows, null ids are kept, an empty table gives an empty result
    and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            judged = [encoders.judge(body.as_py()) for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([j[0] for j in judged], pa.string()),
                    pa.array([j[1] for j in judged], pa.float64()),
                    pa.array([j[2] for j in judged], pa.int64()),
                    pa.array([j[3] for j in judged], pa.float64()),
                ],
                names=["id", "lang_pred", "score", "bytes_over", "margin"],
            )

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bytes_over long, margin double")
    narrow = (F.col("bytes_over") < least_bytes) | (F.col("margin") < least_margin)
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | narrow)


def keep_identified(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    least_bytes: int = 2,
    least_margin: float = 0.01,
) -> DataFrame:
    """The rows whose language is identified, with all their columns, in one pass."""
    columns = docs.columns

    @F.pandas_udf("boolean")
    def accepted(bodies):
        encoders = Encoders(dictionaries)
        judged = bodies.map(encoders.judge)
        return judged.map(lambda j: j[0] != UNKNOWN and j[2] >= least_bytes and j[3] >= least_margin)

    packed = docs.select(F.struct("*").alias("_row"))
    body = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    return packed.filter(accepted(body)).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
