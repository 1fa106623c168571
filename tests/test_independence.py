"""Without the training-data subpackage and the pipeline the rest imports and registers its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_rest_stands_alone(tmp_path):
    shutil.copytree(REPO / "umbel", tmp_path / "umbel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'ranking_core' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    shutil.copy(REPO / "bench.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_it():
    for p in (REPO / "umbel").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "umbel.llm" not in p.read_text(), p


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sample", "algorithm", "package", "votes", "pos"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
