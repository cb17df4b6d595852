import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[*]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tests-"),
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("run"))
