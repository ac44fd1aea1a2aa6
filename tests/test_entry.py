"""Every registered query runs on the smallest tables and, where there is SQL, gives the same rows as DuckDB."""

import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    shown = lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


def test_llm_is_optional():
    """Nothing outside the subpackage imports it."""
    root = os.path.join(os.path.dirname(entry.__file__), "lexweave")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "lexweave.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
