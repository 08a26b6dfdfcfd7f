import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from loomgraph.plans import edits  # noqa: F401  registers its queries
from loomgraph.plans import queries as Q
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
SLOW = {"cycle_edges", "redundant_prerequisites", "prerequisite_ancestors", "apply_auto"}


@pytest.mark.parametrize("name", sorted(Q.SQL.keys() - SLOW))
def test_against_sql(spark, name):
    compare(spark, SF, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(Q.SQL.keys() & SLOW))
def test_traversal_against_sql(spark, name):
    compare(spark, SF, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_training_data_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("loomgraph", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "loomgraph/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(e.oracle_sql().keys() - q.keys()), any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert out.stdout.split(" ", 1)[1].strip() == "[] False"


def test_nothing_else_imports_it():
    root = Path(__file__).resolve().parents[1]
    for path in (root / "loomgraph").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert ".llm" not in path.read_text(encoding="utf-8").replace(".llm_verdict", "").replace(".llm_reason", "")
