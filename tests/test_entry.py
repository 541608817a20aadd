"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    from clausewood import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["contract_diagnostics_by_rule", "i4_sections_index", "x4_money_directives", "r24_anchor_duplicate", "f1_slugify", "f4_iso_dates"])
def test_against_sql(spark, name):
    base = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    from clausewood import queries

    got = queries.queries()[name](spark, SF)
    want = base.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_imports_without_the_operators(tmp_path):
    """The rest works where the operators' folders are gone."""
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for f in (ROOT / "clausewood").rglob("*.py"):
        place = f.relative_to(ROOT)
        if "llm" not in place.parts:
            (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / place).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    n, has_ops, ok = out.stdout.split()
    assert int(n) > 30 and has_ops == "False" and ok == "True"
