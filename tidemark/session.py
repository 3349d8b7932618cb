"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks broadcast or shuffle joins from measured sizes and
# splits skewed partitions, so no operator here forces a broadcast of a side
# that can grow with the data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide feature plans hold thousands of expressions; recording the Python
    # call site of each one takes longer than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or get) a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as it is. Where nothing is set, a local master gets a scratch folder; on a
    cluster each executor would write to its own disk, so that fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[[^\]]*\])?$", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """Path of a new folder next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For intermediate results that several steps read: the work before is done
    once, the columns stay prunable, and a lost executor costs no recomputation.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_with_tasks(module_name: str) -> None:
    """Send a module's functions along with the tasks that call them, so workers
    need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
