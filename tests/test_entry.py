"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    inside = ROOT / "tidewire" / "llm"
    for f in (ROOT / "tidewire").rglob("*.py"):
        if inside not in f.parents:
            assert "tidewire.llm" not in f.read_text()


def test_it_imports_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidewire", tmp_path / "tidewire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.stdout.split()[1:] == ["False", "False"], done.stderr
