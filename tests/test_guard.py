"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "docspark", tmp_path / "docspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120,
    )
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "docspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
