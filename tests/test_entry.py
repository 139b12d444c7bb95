"""The driver's functions work when the training-data operators and the pipeline, which need each other, are gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); assert 'map_naive' in q and set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') and n[2:3].isdigit() or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [["mapforge/llm", "tests/llm"], ["mapforge/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[Path(g).name for g in gone]))
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"
