"""The entry module without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_text_operators(tmp_path, pipeline_too):
    from checks.all_queries import QUERIES, SQL

    for name in ("trackflow", "checks"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if not pipeline_too and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.stdout.split() == [str(len(QUERIES)), str(len(SQL))], ran.stderr
