"""The driver's contract: names, and that the rest works without the deleted folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    """Without their folders, and with or without the pipeline's file, the other queries and their tests are all there."""
    for name in ("newsmill", "tests", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        source = ROOT / name
        if source.exists():
            (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for folder in ("newsmill/llm", "tests/llm"):
        shutil.rmtree(tmp_path / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)
