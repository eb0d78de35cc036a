"""Every registered query of the series engine against DuckDB, and that all names are in order."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from driftline.operators import scoring
from driftline.plans import oracle, queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), oracle.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["window_results", "pipeline_metrics_010"])
def test_windows_are_fitted_once(spark, sf_dir, name, monkeypatch):
    plans, real = [], scoring.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(scoring, "checkpointed", noted)
    found = queries.QUERIES[name](spark, sf_dir)
    assert [p.count("MapInArrow") for p in plans] == [1]
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 22
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, also):
    root = Path(__file__).resolve().parent.parent
    gone = shutil.ignore_patterns(".git", "llm", "__pycache__", *also)
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    assert set(done.stdout.split()) >= set(queries.QUERIES) and "pipeline" not in done.stdout.split()
