"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "cc_pa_full" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)


def test_nothing_else_imports_the_optional_part():
    for folder, _, files in os.walk(os.path.join(REPO, "graphloom")):
        if os.path.basename(folder) != "llm":
            for name in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "graphloom.llm" not in f.read(), name
