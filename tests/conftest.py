"""One local session and the check engine for all tests."""

from __future__ import annotations

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))

from devicepulse.session import build_session  # noqa: E402

TABLES = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "devicepulse-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_slices(spark):
    """Keep every shuffle partition, so that small data still spans several slices."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="session")
def sf_dir():
    if not TABLES.exists():
        pytest.skip("test tables are not here")
    return str(TABLES)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()
