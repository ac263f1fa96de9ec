import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from arbolith.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1", "spark.default.parallelism": "4"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def nodes_frame(spark):
    """(task_id, node_id, parent_id, extra columns with names that operators use inside)."""

    def make(rows):
        return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "task_id string, node_id string, parent_id string, hops int, path string, id string")

    return make
