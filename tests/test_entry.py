"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    out = entry.entry(spark)
    assert out.columns == ["rank", "id", "in_degree", "out_degree", "score"] and out.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_against_sql(spark, sf):
    """A few cheap queries; tools_compare.py runs them all."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("package_coupling", "callers_limited", "journal_state", "net_edges", "rule_actions", "topological_levels", "stale_files"):
        df = entry.queries()[name](spark, sf)
        res = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, res.fetchall())), name


def test_import_without_text_operators(tmp_path):
    """The rest imports and lists its queries where the text operators are gone."""
    import shutil

    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, text = done.stdout.split()
    assert int(n) > 80 and text == "False"
