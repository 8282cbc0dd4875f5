"""The entry module with and without the corpus operators, and some of its queries against DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_without_corpus_operators(tmp_path):
    for p in REPO.iterdir():
        if p.name in ("__spark_entry__.py", "bench.py"):
            (tmp_path / p.name).write_text(p.read_text())
    import shutil

    shutil.copytree(REPO / "lumigraph", tmp_path / "lumigraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not [x for x in q if x.startswith('op')]"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert not run.returncode, run.stderr


def test_with_a_missing_library(tmp_path):
    """A library that only the corpus operators use is missing: the other queries are still there."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cut' in q and e.oracle_sql()['cut'] and not [x for x in q if x.startswith('op')]"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{REPO}"}, capture_output=True, text=True)
    assert not run.returncode, run.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["import_digraph", "index_values", "scc_tree", "diffused_weights", "vertex_stats", "extreme_treecut_stats", "ecdf_at"])
def test_oracle(spark, name):
    from lumigraph.plans import catalog

    c = duckdb.connect()
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    want = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in want.description]
    norm = lambda rows: sorted(tuple(round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in r) for r in rows)
    assert norm(map(tuple, df.select(names).collect())) == norm(want.fetchall())
