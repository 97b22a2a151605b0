"""Spans of sampled traces, decided and kept in one shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obslake.operators import sampling
from obslake.plans import trace_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "trace_id string, span_id string, arrival_ms long, start_ns long, end_ns long, status string, attrs map<string,string>, resource map<string,string>, peer string, `a.b` long"


def _spans(spark):
    """Two tables together: traces of up to nine spans, some late, without an id or an arrival; one whose spans never arrived."""
    r = random.Random(7)
    rows = []
    for k in range(600):
        peer, at = r.choice([None, None, None, "x", "veto"]), r.choice([None] + [r.randrange(30_000)] * 9)
        start = r.choice([0, r.randrange(10**10)])
        trace = f"t{r.randrange(140)}" if k % 50 else None
        rows.append((trace, f"s{k}", at, start, start + r.randrange(10**9), r.choice(["OK"] * 9 + ["ERROR"]), {"peer": peer} if peer else {}, {"peer": r.choice(["x", "y"])} if k % 7 == 0 else {}, None, k))
    rows += [("never", "s", None, 0, 0, "ERROR", {}, {}, None, 1000 + k) for k in range(2)]
    own = F.when(F.map_contains_key("attrs", "peer"), F.col("attrs")["peer"]).otherwise(F.col("resource")["peer"])
    return spark.createDataFrame(rows[::2], SCHEMA).union(spark.createDataFrame(rows[1::2], SCHEMA)).withColumn("peer", own)


def _policies(key):
    slow = sampling.latency("slow", 4 * 10**9)
    return [sampling.string_attribute("no", key, ["veto"], invert=True), sampling.all_of("both", [slow, sampling.string_attribute("x", key, patterns=["^x"])]), sampling.status_code("errors", ["ERROR"]), sampling.probabilistic("some", 30)]


@pytest.mark.parametrize("limits", [{}, {"wait_ms": 9_000}, {"most_spans": 2}, {"wait_ms": 9_000, "most_spans": 2}])
def test_kept_at_once_are_those_of_the_decisions(spark, limits):
    table = _spans(spark).localCheckpoint()
    for policies in (_policies("peer"), [sampling.always("all")]):
        want = sampling.kept_spans(table, sampling.decide(table, policies, **limits))
        got = sampling.keep(table, policies, **limits)
        assert sorted(got.columns) == sorted(want.columns)
        assert 50 < want.count() < 602 and sorted(x["a.b"] for x in got.collect()) == sorted(x["a.b"] for x in want.collect())


def test_a_column_answers_like_the_attribute(spark):
    table = _spans(spark).localCheckpoint()
    a, b = (sorted(map(str, sampling.decide(table, _policies(key), wait_ms=9_000).collect())) for key in ("peer", F.col("peer")))
    assert a == b and {"no", "both", "errors", "some", ""} == {x.split("policy='")[1].split("'")[0] for x in a}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_shuffled_once_and_joined_with_nothing(spark):
    plan = _plan(trace_queries.tail_kept_spans(spark, SF))
    assert plan.count("Exchange hashpartitioning(trace_id") == 1 and "Join" not in plan and plan.count("FileScan") <= 2


def test_maps_of_attributes_do_not_travel(spark):
    """What a policy reads of them is taken before the shuffle."""
    plan = trace_queries.tail_sampling(spark, SF)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Window":
        plan = plan.children().head()
    travels = plan.child().output().mkString(",")
    assert "arrival_ms" in travels and "attrs" not in travels and "resource" not in travels
