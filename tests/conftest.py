import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evenhand.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", partitions=4, app="tests")
    yield s
    s.stop()


@pytest.fixture(params=["one cell", "many cells"])
def both_paths(request, spark):
    """Runs a test with ranges merged into one cell and again with five small ones."""
    many = request.param == "many cells"
    if many:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    if many:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
