import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    """A folder for intermediate tables; a cluster names its own."""
    if spark.conf.get("foliant.scratch", None) is None:
        spark.conf.set("foliant.scratch", "file://" + tempfile.mkdtemp(prefix="spark-llm-"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
