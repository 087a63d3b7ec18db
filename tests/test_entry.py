"""The driver contract."""

from __future__ import annotations

import ast
import pathlib

import pytest

import __spark_entry__ as entry
from rlab.plans import catalog

ROOT = pathlib.Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and df.columns == ["n_queries", "n_with_gt", "top_1", "top_5", "top_10", "mrr", "map"]


def test_nothing_outside_imports_the_corpus_subpackage():
    for path in ROOT.glob("rlab/**/*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalog.ORACLES:
        assert len(set(df.columns)) == len(df.columns)
        return
    con = duckdb.connect()
    for path in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = [tuple(r[k] for k in order) for r in cursor.fetchall()]
    shape = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    norm = lambda found: sorted(str(tuple(shape(float(v) if type(v).__name__ == "Decimal" else v) for v in r)) for r in found)
    assert norm(rows) == norm(want)
