"""The library without its training-data operators: a copy with both folders left out imports and lists its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [set(), {"corpus_pipeline.py"}])
def test_entry_imports_without_the_llm_folders(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: {".git", "__pycache__"} | (also if Path(folder) == ROOT else set()) | ({"llm"} if Path(folder).name in ("crestline", "tests") else set()))
    assert not (copy / "crestline/llm").exists() and not (copy / "tests/llm").exists()
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'funnel_global' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, check=True)
