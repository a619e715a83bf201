"""The entry module without the operators for training data, which may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    return subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_works_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    without = names(tmp_path / "r")
    assert "join5_snow" in without and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in without)


def test_nothing_else_imports_llm():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text()
