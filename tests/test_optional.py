"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_optional_part(tmp_path):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for gone in ("quillgraph/llm", "tests/llm"):
        shutil.rmtree(there / gone, ignore_errors=True)

    def names():
        code = "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"
        run = subprocess.run([sys.executable, "-c", code], cwd=there, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr
        return run.stdout.split()

    found = names()  # the pipeline's module is still there and cannot be imported
    assert "node_export" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
    (there / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names() == found
    files = [str(p) for p in (there / "tests").glob("test_*.py")]
    run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", *files], cwd=there, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout + run.stderr
