from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from obslake.operators import hooks
from obslake.operators.log_metrics import Metric


def test_hooks_fail_open(spark):
    logs = spark.createDataFrame([("a 1", "info", 5), ("boom", None, 6)], "body string, severity_text string, ts_us long")
    got = hooks.parsed_lines(logs, lambda line: {"body": line.split()[1], "ts_us": 9}).orderBy("ts_us").collect()
    assert [tuple(r) for r in got] == [("boom", None, 6), ("1", "info", 9)]
    assert hooks.admitted(logs, F.col("severity_text") == "info").count() == 2
    assert hooks.transformed(logs, lambda d: d.filter("ts_us > 5")).count() == 1
    assert hooks.mapped(logs, lambda p: p[p.ts_us > 5]).count() == 1


def test_scripts_decide_traces(spark):
    spans = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 0)], "trace_id string, n long")
    got = hooks.script_verdicts(spans, lambda s: len(s) > 1 if s[0]["n"] / s[0]["n"] else None)
    assert {r.trace_id: r.verdict for r in got.collect()} == {"a": "sample", "b": "veto", "c": None}


def test_scripts_read_traces_of_any_length_span_by_span(spark):
    spans = spark.range(60_000).select(F.lit("long").alias("trace_id"), F.col("id").alias("n")).unionByName(spark.createDataFrame([("b", 5), ("odd", None), (None, 1)], "trace_id string, n long"))
    got = hooks.script_folds(spans, int, lambda total, s: total + s["n"], lambda total: total > 10 if total else None)
    assert {r.trace_id: r.verdict for r in got.collect()} == {"long": "sample", "b": "veto", "odd": None, None: "veto"}
    assert {r.trace_id: r.verdict for r in hooks.script_verdicts(spans, lambda s: len(s) == 60_000).collect()}["long"] == "sample"
    assert hooks.script_folds(spans.limit(0), int, max, bool).count() == 0


def test_emitted_metrics_are_declared(spark):
    seen = spark.createDataFrame([("m", "{}", "{}", 1, 2.0)], "metric string, labels string, resource_labels string, ts_us long, value double")
    assert hooks.with_emitted(seen, seen, [Metric("m")]).count() == 2
    with pytest.raises(Exception, match="isn't declared"):
        hooks.with_emitted(seen, seen, [Metric("n")]).collect()
