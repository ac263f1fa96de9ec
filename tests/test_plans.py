"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from arbolith.plans import core
from tests.compare import SMALL, assert_same, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_a_leftover_folder_of_the_subpackage_is_no_error(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "arbolith"), tmp_path / "arbolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "arbolith" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path)
