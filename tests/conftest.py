from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from golden_tables import find_golden

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tidemark-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def golden(spark):
    """Load the published table with the given columns, or skip."""
    from tidemark.sources.exports import read_table_csv

    def load(*columns: str, schema=None):
        paths = find_golden(*columns)
        if not paths:
            pytest.skip("published tables not found")
        return read_table_csv(spark, paths[0], schema)

    return load
