import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], brute.DOCS)


@pytest.fixture(scope="session")
def nameless(spark):
    """Only rows without doc_id."""
    return spark.createDataFrame([(None, "no name " * 20, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)], brute.DOCS)
