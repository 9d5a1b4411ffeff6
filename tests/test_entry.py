"""The entry module works without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_subpackage(tmp_path, with_pipeline):
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
