"""The registered queries against their SQL twins."""

from __future__ import annotations

import pathlib

import pytest

import __spark_entry__ as entry
from rlab.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for path in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(str(tuple(r[k] for k in order)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
