"""Every registered query that has SQL against DuckDB on a small table set; the entry module with and without the training-data subpackage."""

from __future__ import annotations

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, str(REPO))

import __spark_entry__ as E  # noqa: E402

QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v) -> str:
    if v is None or isinstance(v, bool) or not isinstance(v, float):
        return str(v)
    return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL and not k.startswith("op") and k != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_library_stands_without_the_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline imports, and no module outside names them."""
    for p in [*(REPO / "marketbars").rglob("*.py"), REPO / "__spark_entry__.py"]:
        rel = p.relative_to(REPO)
        if "llm" in rel.parts:
            continue
        if rel.name != "__spark_entry__.py":
            assert "llm" not in p.read_text()
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')]; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
