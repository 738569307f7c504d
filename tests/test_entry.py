"""The entry module in a copy of the repository without the corpus package."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_queries_without_the_corpus_package(tmp_path):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (at / name).unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=at, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)}, check=True)
