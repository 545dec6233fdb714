"""Every query against its SQL on the smallest test tables."""

import glob
import os
import subprocess
import sys

import pytest

from quirelight.plans import catalogue, roundtrips  # noqa: F401


def _rows(table):
    names = sorted(table.column_names)
    return sorted(map(str, zip(*[table.column(n).to_pylist() for n in names]))), names


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, data, duck):
    found = catalogue.QUERIES[name](spark, data).toArrow()
    if name in catalogue.SQL:
        wanted = duck.sql(catalogue.SQL[name]).to_arrow_table()
        assert _rows(found) == _rows(wanted)
    else:
        assert found.num_rows > 0


def test_import_without_session():
    """The driver reads the names before there is a session, also where the subpackage for training data is gone."""
    code = "import sys{}; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    counts = [int(subprocess.run([sys.executable, "-c", code.format(x)], cwd=root, capture_output=True, text=True, check=True).stdout) for x in ("", "; sys.modules['quirelight.llm'] = None")]
    assert counts[1] == len(catalogue.QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
