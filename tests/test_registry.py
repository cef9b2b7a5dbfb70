"""Every registered query against its SQL in DuckDB, and the rest of the repository without llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from inkwell.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    want = db.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_the_rest_stands_without_llm(tmp_path):
    for part in ("inkwell", "__spark_entry__.py"):
        src = ROOT / part
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / part)
    shutil.rmtree(tmp_path / "inkwell" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_llm():
    for f in (ROOT / "inkwell").rglob("*.py"):
        if "llm" not in f.parts:
            text = f.read_text()
            assert "inkwell.llm" not in text and "from .llm" not in text and "..llm" not in text
