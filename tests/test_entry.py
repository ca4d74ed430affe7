"""The entry point without the training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; n = set(e.queries()); print(len(n), sum(x.startswith('op') and x[2].isdigit() for x in n), 'pipeline' in n, set(e.oracle_sql()) <= n)"


def run(folder, *args):
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    folder = tmp_path_factory.mktemp("without") / "repo"
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", "*.json"))
    return folder


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_training_data_part(copy, pipeline):
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink()
    shown = run(copy, "-c", SHOW)
    assert shown.returncode == 0, shown.stderr
    count, numbered, has_pipeline, covered = shown.stdout.split()
    assert int(count) > 90 and (numbered, has_pipeline, covered) == ("0", "False", "True")


def test_tests_are_collected_without_the_training_data_part(copy):
    collected = run(copy, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout[-2000:]


def test_absent_libraries_leave_the_part_out(copy, tmp_path):
    source = REPO / "barloom" / "llm"
    if not source.exists():
        pytest.skip("there is no training-data part")
    block = "import sys; sys.modules['zstandard'] = None; "
    shown = run(REPO, "-c", block + SHOW)
    assert shown.returncode == 0, shown.stderr
    assert shown.stdout.split()[1:] == ["0", "False", "True"]
