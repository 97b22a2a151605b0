"""Late spans: streams settle as batches do, and both as a fold over plain lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obslake.operators import late, sampling
from obslake.streaming import traces

from .test_streams import _run, _stream

SCHEMA = "trace_id string, span_id string, status string, start_ns long, end_ns long, arrival_ms long, attrs map<string,string>, resource map<string,string>"
POLICIES = lambda: [sampling.status_code("errors", ["ERROR"])]  # noqa: E731  columns need a session
CARRY = ("trace_id", "span_id", "arrival_ms")


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def _spans(spark, rows):
    return spark.createDataFrame([(t, s, status, 1, 2, at, {}, {}) for t, s, status, at in rows], SCHEMA)


def _batch(spans, wait="5 seconds", ttl_ms=30_000, carry=()):
    return late.settled_sessions(late.trace_sessions(spans.withColumn("arrival_ts", F.timestamp_millis("arrival_ms")), POLICIES(), wait, carry), ttl_ms)


def _fold(rows, wait, ttl):
    out, by = [], {}
    for t, _, status, at in sorted(rows, key=lambda r: r[3]):
        s = by.setdefault(t, [])
        if s and at <= s[-1][1]:  # a span that comes just when a session would close belongs to it
            s[-1] = (s[-1][0], at + wait, s[-1][2] + 1, s[-1][3] or status == "ERROR")
        else:
            s.append((at, at + wait, 1, status == "ERROR"))
    for t, sessions in by.items():
        until = verdict = None
        for a, b, n, failed in sessions:
            was = until is not None and a < until
            if not was:
                until, verdict = b + ttl, "sample" if failed else "drop"
            out.append((t, a, b, n, verdict, was))
    return sorted(out)


def _shape(rows):
    return sorted((r.trace_id, r.start_ms, r.end_ms, r.n_spans, r.verdict, r.late) for r in rows)


#: The first session of "a" fails and ends at 7,000: a verdict until 37,000. One at 36,999 is late though it ends after that; one at 44,000 is fresh.
ROWS = [("a", "1", "ERROR", 1000), ("a", "2", "UNSET", 2000), ("a", "3", "UNSET", 20_000), ("a", "4", "UNSET", 36_999), ("a", "5", "UNSET", 44_000), ("a", "6", "ERROR", 60_000), ("b", "1", "UNSET", 1000), ("b", "2", "ERROR", 30_000), ("b", "3", "ERROR", 36_000)]


def test_late_spans_share_the_verdict_until_it_is_forgotten(spark):
    out = _batch(_spans(spark, ROWS), carry=CARRY).cache()
    assert _shape(out.collect()) == _fold(ROWS, 5000, 30_000)
    assert [(r.start_ms, r.verdict, r.late) for r in sorted(out.filter("trace_id = 'a'").collect(), key=lambda r: r.start_ms)] == [
        (1000, "sample", False), (20_000, "sample", True), (36_999, "sample", True), (44_000, "drop", False), (60_000, "drop", True)]
    spans = late.kept(out, "trace_id string, span_id string, arrival_ms long").collect()
    assert sorted((r.trace_id, r.span_id, r.late) for r in spans) == [("a", "1", False), ("a", "2", False), ("a", "3", True), ("a", "4", True), ("b", "3", False)]
    assert _batch(_spans(spark, ROWS).limit(0)).count() == 0


def test_streams_settle_as_batches_do(spark, rocksdb, tmp_path):
    rng = random.Random(2)
    rows = ROWS + [(f"t{rng.randrange(12)}", str(k), rng.choice(["ERROR", "UNSET", "UNSET"]), 1000 * rng.randrange(300)) for k in range(200)]
    end = [("end", "1", "UNSET", 10**9)]
    stream = traces.settled(_stream(spark, _spans(spark, rows + end), tmp_path, "arrival_ms"), POLICIES(), "5 seconds", 30_000, "10 seconds", CARRY)
    got = _run(spark, stream, "settled")
    assert _shape(got.collect()) == _fold(rows, 5000, 30_000) == _shape(_batch(_spans(spark, rows)).collect())
    schema = "trace_id string, span_id string, arrival_ms long"
    both = [sorted(map(tuple, late.kept(x, schema).collect())) for x in (got, _batch(_spans(spark, rows), carry=CARRY))]
    assert both[0] == both[1] and both[0]


def test_state_goes_with_its_time(spark, rocksdb, tmp_path):
    """A session that begins after the verdict is forgotten is decided anew, long after the timer too."""
    rows = [("a", "1", "ERROR", 1000), ("x", "1", "UNSET", 500_000), ("a", "2", "UNSET", 10**6), ("x", "2", "UNSET", 2 * 10**6), ("a", "3", "ERROR", 3 * 10**6), ("end", "1", "UNSET", 10**9)]
    out = traces.settled(_stream(spark, _spans(spark, rows), tmp_path, "arrival_ms"), POLICIES(), longest_ms=1000)
    assert [(r.start_ms, r.verdict) for r in sorted(_run(spark, out, "forgotten").filter("trace_id = 'a'").collect(), key=lambda r: r.start_ms)] == [(1000, "sample"), (10**6, "drop"), (3 * 10**6, "sample")]
