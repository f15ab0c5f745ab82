"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from newsloom.plans.oracles import oracles
from newsloom.plans.queries import QUERIES
from tools.check_queries import connect, rows_of

FOLDER = os.environ.get("NEWSLOOM_TEST_TABLES", "/root/testdata/sf0.001")
ORACLES = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)
    assert {n: got.schema.field(n).type for n in got.column_names} == {
        n: want.schema.field(n).type for n in want.column_names
    }


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "doc_id", "n_chars", "n_parts", "whole_chunks", "wanted_chunks", "n_chunks",
    ]


def test_import_from_zip():
    """The entry imports where PySpark is a zip file and no folder of it is on the path."""
    import pyspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    inner = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = [os.path.join(inner, f) for f in os.listdir(inner) if f.endswith(".zip")] if os.path.isdir(inner) else []
    if not any("pyspark" in z for z in zips):
        pytest.skip("no pyspark.zip here")
    code = (
        f"import sys; sys.path[:0] = {zips!r}; sys.path.insert(0, {root!r}); import pyspark; "
        "assert '.zip' in pyspark.__file__, pyspark.__file__; "
        "import __spark_entry__ as e; assert len(e.queries()) > 70 and len(e.oracle_sql()) > 70"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/")
    assert done.returncode == 0, done.stderr
