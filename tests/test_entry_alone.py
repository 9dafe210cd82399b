"""The entry module without the optional subpackage and without the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; from reelspan.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and e.oracle_sql() == c.SQL; print('fine')"


@pytest.mark.parametrize("gone", [("reelspan/llm",), ("corpus_pipeline.py",), ("reelspan/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse", *(g.rsplit("/", 1)[-1] for g in gone)))
    say = SAY if "reelspan/llm" in gone else SAY.replace("set(e.queries()) == set(c.QUERIES) and e.oracle_sql() == c.SQL", "'pipeline' not in e.queries() and set(c.SQL) <= set(e.oracle_sql())")
    done = subprocess.run([sys.executable, "-c", say], cwd=tree, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(tree), "PATH": "/usr/bin:/bin"}, check=False)
    assert done.stdout.strip().endswith("fine"), done.stderr


@pytest.mark.parametrize("emptied", [True, False])
def test_entry_with_an_emptied_folder(tmp_path, emptied):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    (tree / "reelspan/llm").mkdir(exist_ok=True)
    for file in (tree / "reelspan/llm").iterdir():
        if file.is_file() and (emptied or file.name != "__init__.py"):
            file.unlink()
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tree, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(tree), "PATH": "/usr/bin:/bin"}, check=False)
    assert done.stdout.strip().endswith("fine"), done.stderr
