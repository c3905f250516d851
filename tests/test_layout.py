"""The rest of the repository without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

HERE = pathlib.Path(__file__).resolve().parents[1]

PROBE = """
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
"""


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    for gone in ("nothing more", "corpus_pipeline.py"):
        (copy / gone).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
        assert done.returncode == 0, done.stderr
