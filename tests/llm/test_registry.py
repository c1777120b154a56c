"""The registered queries and, where SQL can say what they give, the SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quern.llm import registry


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 3) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
