"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tickloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.4f}".replace("-0.0000", "0.0000")
        return str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def close(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b):
        if x != y:
            try:
                if not math.isclose(float(x), float(y), rel_tol=1e-4, abs_tol=2e-4):
                    return False
            except ValueError:
                return False
    return True


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.SQL:
        assert list(got.columns)
        return
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for x, y in zip(a, b)), [(x, y) for x, y in zip(a, b) if not close(x, y)][:3]


def test_the_engine_does_not_need_the_text_operators():
    for path in glob.glob(os.path.join(os.path.dirname(catalog.__file__), "..", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "tickloom.llm" not in open(path).read(), path


def test_names_can_be_read_without_a_session():
    root = os.path.abspath(os.path.join(os.path.dirname(catalog.__file__), "..", ".."))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env={**os.environ, "PYTHONPATH": root})
