"""The driver contract where the training-text operators are not there."""

import os
import shutil
import subprocess
import sys

import pytest

from tocsin.plans.queries import registered

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(f"{TOP}/tocsin", copy / "tocsin", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py", "corpus_pipeline.py"]
    for name in names if pipeline else names[:1]:
        if os.path.exists(f"{TOP}/{name}"):
            shutil.copy(f"{TOP}/{name}", copy)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split() == ["True", str(len(registered()))]
