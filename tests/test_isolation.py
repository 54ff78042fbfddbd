"""Without the optional subpackage and the pipeline, the entry imports and the library's queries stand."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def copied(tmp_path, *gone):
    """The repository's code and tests without the folders of the corpus operators."""
    shutil.copytree(ROOT / "nitraflow", tmp_path / "nitraflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if name not in gone:
            shutil.copy(ROOT / name, tmp_path)
    return {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_stands_without_the_optional_parts(tmp_path, gone):
    env = copied(tmp_path, *gone)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_the_other_tests_collect(tmp_path):
    env = copied(tmp_path, "corpus_pipeline.py")
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "error" not in done.stdout.lower().split("\n")[-2], done.stdout[-2000:]


def test_nothing_else_imports_the_corpus_operators():
    for path in [*(ROOT / "nitraflow").rglob("*.py")]:
        if "llm" not in path.parts:
            assert "nitraflow.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
