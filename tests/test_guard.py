"""The library and its entry stand without the training-data subpackage and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; from roadlark.queries.registry import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "roadlark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(encoding="utf-8"), p
