"""The rest works when the llm folders and the pipeline are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "twinsift", tmp_path / "twinsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "twinsift").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "twinsift.llm" not in path.read_text(), path
