"""The driver's entry point, with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(','.join(sorted(e.queries()))); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_queries_without_the_corpus_operators(tmp_path, keep_pipeline):
    for name in ("ledgerloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (source := ROOT / name).is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists() and (keep_pipeline or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    names = out.strip().split(",")
    assert "q01_best_row_dedupe" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
