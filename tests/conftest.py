import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from starloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def tiny_tasks(spark):
    """A task limit so small that every group of the test data is divided."""
    spark.conf.set("spark.starloom.rowsPerTask", "40")
    yield
    spark.conf.unset("spark.starloom.rowsPerTask")
