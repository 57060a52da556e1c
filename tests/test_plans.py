"""Plan checks: the core batch operators stay JVM-side (no Python nodes), and scans read only the
columns they need."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
JVM_ONLY = ["corpus_tokens", "folder_tokens", "folder_state_tri", "scan_summary", "build_context", "pack_tokens",
            "pack_chars_xml", "gitignore_filter", "apply_events_keep_selection", "snapshot_diff", "drift_new", "resolve_drift", "apply_events"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_plan(spark, name):
    plan = _plan(spark, name)
    assert not any(p in plan for p in PYTHON_NODES), name


def test_scan_prunes_text(spark):
    # the drift query needs paths and times only: no scan of it reads the text column
    plan = _plan(spark, "drift_new")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("text" not in s for s in schemas), schemas
