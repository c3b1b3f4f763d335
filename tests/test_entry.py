"""The entry module works without the subpackage of training-text operators, whose folders may be removed."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
assert "target_heatmap" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
assert set(sql) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert entry.queries()["target_heatmap"](spark, DATA).count() > 0
"""


def test_entry_without_the_llm_folders(tmp_path, data):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert not (copy / "murmuration" / "llm").exists() and (copy / "corpus_pipeline.py").exists()
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", PROBE.replace("DATA", repr(data))], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    if (ROOT / "murmuration" / "llm").exists():
        assert "pipeline" in names and {n[:3] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 10)}
    assert set(entry.oracle_sql()) <= set(names)
