"""Queries against their SQL on the smallest tables, where these and DuckDB are there."""

import os

import pytest

from tallyforge import queries

SMALL = os.environ.get("SMALL_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLE.keys()


@pytest.mark.parametrize("name", ["code_functions", "code_files", "code_projects", "code_status", "code_errors", "code_labels", "dup_by_doc", "dup_project", "fan_in_parts", "js_metrics", "ridge_predict_quality"])
def test_equal_to_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=top, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) >= len(queries.QUERIES), done.stderr
