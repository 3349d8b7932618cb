"""Compare registered queries with their SQL in DuckDB.

Run as a script for one or more queries: ``python tests/oracle.py SF_DIR [NAME...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value both engines print alike; -0.0 and NaN are made visible."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {
    "IntegerType": "INTEGER",
    "LongType": "BIGINT",
    "DoubleType": "DOUBLE",
    "StringType": "VARCHAR",
    "DateType": "DATE",
    "BooleanType": "BOOLEAN",
}


def differences(spark, connection, run, sql: str, sf_dir: str) -> list[str]:
    """What differs between the Spark result and the oracle; empty when equal."""
    df = run(spark, sf_dir)
    got_columns, got = normal(df.columns, df.collect())
    cursor = connection.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_columns, want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    found = []
    for field in df.schema.fields:
        kind = KINDS.get(type(field.dataType).__name__)
        if kind != types[field.name]:
            found.append(f"type of {field.name}: {field.dataType} vs {types[field.name]}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    pairs = [(a, b) for a, b in zip(got, want) if a != b]
    found += [f"{a} != {b}" for a, b in pairs[:3]]
    if pairs:
        found.append(f"{len(pairs)} rows differ")
    if not got:
        found.append("no rows")
    return found


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                 "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = connect(sf_dir), oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, connection, run, oracles[name], sf_dir)
                verdict = "ok" if not found else "DIFFERS " + " | ".join(f[:600] for f in found)
            else:
                verdict = f"rows only: {run(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = "FAILS " + str(error)[:1500]
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
