"""CSV exports: folder scans with a required-column guard, and single files."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import keep_table, ship_with_tasks

ship_with_tasks(__name__)

HEADER_SCHEMA = "path string, source_file string, header string"
#: Bits of a row's number within its task, and of a block's place in its file.
ROW_BITS, BLOCK_BITS = 33, 42
#: Bytes read at a time until the first record ends.
HEADER_STEP = 1 << 16


def _first_record(path: str) -> str:
    """The first record of one file, on whichever executor holds the task.

    It ends at the first line break outside quotes, wherever that is.
    """
    if path.startswith("file:"):
        handle = open("/" + path[len("file:"):].lstrip("/"), "rb")
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        handle = system.open_input_stream(inner)
    head, at, quoted = b"", 0, False
    with handle:
        while step := handle.read(HEADER_STEP):
            head += step
            while at < len(head):
                if head[at] == 0x22:
                    quoted = not quoted
                elif head[at] == 0x0A and not quoted:
                    return head[:at].decode("utf-8-sig", "replace").rstrip("\r")
                at += 1
    return head.decode("utf-8-sig", "replace").rstrip("\r")


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(header=[_first_record(path) for path in batch["path"]])


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Paths of the folder's files; the pruned content column is never read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        return listing.load(folder).select("path", F.col("_metadata.file_path").alias("source_file"))
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot list {folder}") from error


def read_export_folder(
    spark: SparkSession,
    folder: str,
    required: Sequence[str],
    pattern: str = "*.csv",
    multi_line: bool = True,
    optional: Sequence[str] = (),
) -> DataFrame:
    """All files of a folder that have the required columns, as strings.

    Headers are read in parallel; files lacking a required column are skipped, an
    ``optional`` column is null where a file lacks it. Files with the same header
    share one CSV scan, so the number of scans is the number of layouts, not of
    files. ``source_file`` names a row's file and ``source_row`` orders all rows by
    file path and place in the file, however files are packed into tasks. ``multi_line`` keeps quoted line breaks whole; turn it
    off for huge files without any, which then split.
    """
    files = list_files(spark, folder, pattern)
    headers = files.mapInPandas(_read_headers, HEADER_SCHEMA).withColumn("layout", F.md5("header"))
    headers = keep_table(headers)
    # Header texts come once per layout; per file, the path (which Spark's own file
    # listing holds on the driver as well) and a digest.
    layouts_found = {r.layout: r.header for r in headers.select("layout", "header").distinct().collect()}
    if not layouts_found:
        raise FileNotFoundError(f"no {pattern} files in {folder}")

    named = {k: tuple(next(csv.reader([h]), ())) for k, h in layouts_found.items()}
    fitting = {k: names for k, names in named.items() if set(required) <= set(names)}
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in headers.select("path", "layout").orderBy("path").collect():
        if row.layout in fitting:
            layouts.setdefault(fitting[row.layout], []).append(row.path)
    if not layouts:
        raise ValueError(f"no file in {folder} has the columns {sorted(required)}")
    wanted = [*required, *[c for c in optional if c not in required]]

    # As many rows as files, which the driver lists anyway.
    order = Window.orderBy("source_file")
    ranks = headers.select("source_file", F.row_number().over(order).cast("decimal(38,0)").alias("_rank"))
    scans = []
    for names, paths in layouts.items():
        # Columns nobody asked for may repeat a name; positions keep them apart.
        columns = [n if n in wanted and names.index(n) == i else f"_c{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        scan = spark.read.csv(
            paths, schema=schema, header=True, enforceSchema=True, escape='"', multiLine=multi_line
        )
        scans.append(
            scan.select(
                *[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in wanted],
                F.col("_metadata.file_path").alias("source_file"),
                F.col("_metadata.file_block_start").cast("decimal(38,0)").alias("_block"),
                F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1).cast("decimal(38,0)").alias("_row"),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b), scans).join(ranks, "source_file")
    place = (F.col("_rank") * F.lit(2**BLOCK_BITS) + F.col("_block")).cast("decimal(30,0)") * F.lit(2**ROW_BITS)
    place = (place.cast("decimal(38,0)") + F.col("_row")).cast("decimal(38,0)")
    return rows.select(*[F.col(f"`{c}`") for c in wanted], "source_file", place.alias("source_row"))


def read_table_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """One CSV file with a header; types are inferred only when no schema is given.

    ``multi_line`` keeps quoted line breaks whole, which takes one task per file; turn it
    off for a file without any, which then is read by as many tasks as it has splits.
    """
    return spark.read.csv(
        path, schema=schema, header=True, inferSchema=schema is None, escape='"', multiLine=multi_line
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail at planning time when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df
