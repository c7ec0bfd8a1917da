"""Plan-level guards over every registered query (smallest scale)."""

import pytest

import __spark_entry__ as entry
from conftest import SF001

PYTHON_STAGES = {"enrich_status", "run_summary", "document_flow", "stage_replacement"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF001)) for name, fn in entry.queries().items()}


def test_no_cross_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


def test_python_only_where_user_functions_run(plans):
    arrow = {n for n, p in plans.items() if "MapInPandas" in p or "ArrowEvalPython" in p}
    assert arrow <= PYTHON_STAGES


def test_scans_are_pruned(plans):
    # the wide text tables are never read whole when a query needs a few columns
    p = plans["artifact_keys"]
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p
    assert "html" not in p.split("ReadSchema")[1].split("\n")[0]
