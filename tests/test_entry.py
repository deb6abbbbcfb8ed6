import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import __spark_entry__ as e
from korrel import plans
assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()) - len(plans.queries()))
"""


def run(folder):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return int(done.stdout)


def copy(to, *without):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "korrel"):
        if name not in without and (REPO / name).exists():
            (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, to / name)
    if "llm" in without:
        shutil.rmtree(to / "korrel/llm", ignore_errors=True)


def test_with_all(tmp_path):
    copy(tmp_path)
    assert run(tmp_path) in (0, 11)


def test_without_the_subpackage(tmp_path):
    copy(tmp_path, "llm", "corpus_pipeline.py")
    assert run(tmp_path) == 0


def test_with_an_empty_leftover_folder(tmp_path):
    copy(tmp_path, "llm", "corpus_pipeline.py")
    (tmp_path / "korrel/llm/__pycache__").mkdir(parents=True)
    assert run(tmp_path) == 0


def test_when_the_subpackage_cannot_be_imported(tmp_path):
    copy(tmp_path)
    if (tmp_path / "korrel/llm/queries.py").exists():
        (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')\n")
        assert run(tmp_path) == 0


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and [r.average for r in rows] == sorted((r.average for r in rows), reverse=True)


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "korrel").rglob("*.py"):
        if "llm" not in path.parts:
            assert "korrel.llm" not in path.read_text()
