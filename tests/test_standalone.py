"""The package without its optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry(folder: str) -> str:
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": folder})
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_the_rest_stands_alone(tmp_path):
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skipped)
    count, pipeline, corpus, oracles = _entry(str(tmp_path / "repo")).split()
    assert int(count) > 70 and (pipeline, corpus, oracles) == ("False", "False", "True")
    (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _entry(str(tmp_path / "repo")).split()[0] == count
