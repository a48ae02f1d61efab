"""What is left when the text operators are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("caches", [False, True])
def test_entry_without_the_text_operators(tmp_path, caches):
    shutil.copytree(ROOT / "tessel", tmp_path / "tessel", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if caches:
        (tmp_path / "tessel/llm/__pycache__").mkdir(parents=True)
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path) if (ROOT / "corpus_pipeline.py").exists() else None
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
