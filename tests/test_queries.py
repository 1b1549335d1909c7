"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
LLM = lambda q: q.startswith("op") or q in ("pipeline", "langid_pages")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [q for q in __spark_entry__.oracle_sql() if not LLM(q)])
def test_sql(spark, duck, tmp_path, name):
    df = __spark_entry__.queries()[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    rows = lambda source: sorted(map(repr, duck.sql(f"SELECT {columns} FROM {source}").fetchall()))
    got = rows(f"'{tmp_path}/out/*.parquet'")
    assert got and got == rows(f"({__spark_entry__.oracle_sql()[name]})")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "word", "n"]
