from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stopwise.session import build_session  # noqa: E402

# Made on import, since test modules hold column expressions.
SESSION = build_session(
    "tests",
    "local[8]",
    spark__sql__shuffle__partitions="4",
    spark__ui__enabled="false",
    spark__ui__showConsoleProgress="false",
    spark__checkpoint__dir=tempfile.mkdtemp(prefix="stopwise-tests-"),
    spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="stopwise-warehouse-"),
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Values of columns over a one-row frame: ``one("text string", ("7",), column)``."""

    def evaluate(schema, row, *columns):
        return tuple(spark.createDataFrame([row], schema).select(*columns).first())

    return evaluate
