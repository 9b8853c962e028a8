"""The library without the training-data subpackage, with and without the pipeline module beside it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    place = tmp_path / "repo"
    shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=place, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
