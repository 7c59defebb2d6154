"""The entry without the training-data operators: every other query must still be there."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from conftest import ROOT

COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_training_data(tmp_path, left_out):
    if not os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        pytest.skip("nothing to leave out")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *left_out))
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    names = set(done.stdout.split()[2:])
    training = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
    if "llm" in left_out:
        assert names == set(entry.queries()) - training
    else:
        assert names == set(entry.queries()) - {"pipeline"}


def test_a_broken_operator_is_not_passed_over(tmp_path):
    if not os.path.exists(f"{ROOT}/tillflow/llm"):
        pytest.skip("nothing to break")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    with open(copy / "tillflow" / "llm" / "bpe.py", "a") as f:
        f.write("\nimport no_such_module\n")
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
