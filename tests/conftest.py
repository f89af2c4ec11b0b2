import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runlens.session import HOT_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Groups of more than 20 rows are split over several tasks."""
    spark.conf.set(HOT_ROWS_CONF, "20")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def rows(df, *order):
    """The rows of a frame as dictionaries, sorted."""
    return [r.asDict(True) for r in df.orderBy(*order).collect()] if order else [r.asDict(True) for r in df.collect()]
