from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    for p in (ROOT / "loomwork").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                assert "llm" not in (getattr(n, "module", None) or "") and all("llm" not in a.name for a in n.names), p


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "profile_events", "table_lineage", "session", "join_multiway"])
def test_queries_match_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    assert sorted(tuple(show(r[c]) for c in sorted(got.columns)) for r in got.collect()) == want
