"""The entry points with and without the subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len([k for k in q if k.startswith('op')]), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def test_entry_points(tmp_path):
    run = lambda d: subprocess.run([sys.executable, "-c", SAY], cwd=d, env=os.environ | {"PYTHONPATH": str(d)}, capture_output=True, text=True, check=True).stdout.split()
    assert run(ROOT)[-3:] == ["13", "True", "True"]
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(tmp_path / "r" / "recollect" / "llm")
    os.remove(tmp_path / "r" / "corpus_pipeline.py")
    assert run(tmp_path / "r")[-2:] == ["False", "True"]
