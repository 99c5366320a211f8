"""The library without the corpus operators: what is left imports and lists its queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("corpus_pipeline.py",), ("prefixlake/llm",), ("prefixlake/llm", "corpus_pipeline.py")])
def test_queries_are_listed_without_the_corpus_operators(gone, tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", ".pytest_cache"))
    for x in gone:
        shutil.rmtree(to / x) if os.path.isdir(to / x) else os.path.exists(to / x) and os.remove(to / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tier0_exact_match' in q and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q"
    env = {**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(ROOT, str(to))}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=to, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
