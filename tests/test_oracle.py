"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; the entry point works without the llm subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pricegrain import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        return "null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir).toPandas()
    if name not in registry.oracle_sql():
        assert len(found)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(found) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_without_llm(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "pricegrain"):
        (tmp_path / name).symlink_to(repo / name) if name.endswith(".py") else None
    (tmp_path / "pricegrain").mkdir()
    for p in (repo / "pricegrain").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "pricegrain" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[1:] == ["False"], out.stderr
