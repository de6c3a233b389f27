"""The entry module and the library without the corpus subpackage."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT

#: What a copy of the repository needs; nothing that is generated.
PARTS = ("__spark_entry__.py", "corpus_pipeline.py", "bench.py", "fringeflow", "tests")

CHECK = """
import __spark_entry__ as entry
from fringeflow.plans import catalog
found, sql = entry.queries(), entry.oracle_sql()
assert set(found) == set(catalog.queries()), set(found) ^ set(catalog.queries())
assert set(sql) == set(catalog.oracle_sql())
import bench, fringeflow.cli
print(len(found))
"""


def test_without_the_corpus_folders(tmp_path):
    """With both folders deleted, and with corpus_pipeline.py gone too, the entry module imports and registers all other queries."""
    for part in PARTS:
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        else:
            shutil.copy(source, tmp_path / part)
    assert not (tmp_path / "fringeflow" / "llm").exists() and not (tmp_path / "tests" / "llm").exists()
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", CHECK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
        assert done.returncode == 0, done.stderr[-2000:]
        assert int(done.stdout.split()[-1]) > 150
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    listed = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert listed.returncode == 0, listed.stdout[-2000:]


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "fringeflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "fringeflow.llm" not in path.read_text(), path
