import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import build_session

    session = build_session("tests", master="local[4]", partitions=4, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Treat groups of more than 20 rows as too large for one task."""
    spark.conf.set("foliant.hotRows", "20")
    yield spark
    spark.conf.unset("foliant.hotRows")
