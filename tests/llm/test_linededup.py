"""Line deduplication: empty tables and the plan (the rule: test_linededup_runs.py)."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from test_linededup_runs import run  # noqa: E402
from treecut.llm import linededup as L  # noqa: E402


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.dedup_lines(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns(spark):
    names = ["_row", "_cuts", "_lines", "_text", "_key", "_n", "_h", "c0", "kept", "_shorter"]
    docs = [(1, "a b\nc d\ne"), (2, "x\na b\nc d"), (3, None)]
    d = spark.createDataFrame([(i, t, *names) for i, t in docs], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = {r.doc_id: r for r in L.dedup_lines(d).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["a b\nc d\ne", "x", None]
    assert all(got[i][n] == n for i in got for n in names)
