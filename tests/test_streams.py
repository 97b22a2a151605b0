"""Streams give what batches give, over the same rows in several files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from obslake.operators import log_metrics, logs, sampling, spans
from obslake.operators.log_metrics import Metric
from obslake.plans.views import log_table, span_table
from obslake.sources.writers import routed_batches
from obslake.streaming import logs as stream_logs
from obslake.streaming import traces

SF = "/root/testdata/sf0.001"


def _stream(spark, df, path, order: str):
    """df as a stream of several files in the given order, and a last file that moves the watermark on."""
    rows = df.count()
    ranked = df.withColumn("_f", F.expr(f"ntile(4) over (order by {order})"))
    for k in range(1, 5):
        ranked.filter(f"_f = {k}").drop("_f").coalesce(1).write.mode("append").parquet(str(path))
    assert rows
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(spark, df, name: str, mode: str = "append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def some_spans(spark):
    end = span_table(spark, SF).limit(1).withColumns({"arrival_ms": F.lit(4_000_000_000_000).cast("long"), "trace_id": F.lit("end"), "kind": F.lit("CLIENT")})
    return span_table(spark, SF).filter("arrival_ms % 5 < 6").unionByName(end).cache()


def test_chain_on_a_stream(spark, tmp_path):
    table = log_table(spark, SF)
    config = logs.ChainConfig(lifts=[logs.Lift("took_ms", "took")])
    got = _run(spark, logs.before_rules(_stream(spark, table, tmp_path, "log_id"), config).select("log_id", "body", "severity_text"), "chain")
    want = logs.before_rules(table, config).select("log_id", "body", "severity_text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_span_metrics_on_a_stream(spark, some_spans, tmp_path):
    got = _run(spark, spans.span_red(_stream(spark, some_spans, tmp_path, "start_ns"), ("http.status_code",)), "red", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, spans.span_red(some_spans, ("http.status_code",)).collect()))


def test_sessions_decide_as_batches_do(spark, some_spans, tmp_path):
    policies = [sampling.status_code("errors", ["ERROR"]), sampling.latency("slow", 3_000_000_000), sampling.probabilistic("some", 20)]
    once = some_spans.groupBy("trace_id").agg((F.max("arrival_ms") - F.min("arrival_ms")).alias("w")).filter("w < 60000")
    few = some_spans.join(once.select("trace_id"), "trace_id")
    got = _run(spark, traces.decisions(_stream(spark, few, tmp_path, "arrival_ms"), policies, "1 hour", "1 hour"), "decided")
    want = sampling.decide(few, policies).filter("trace_id <> 'end'").select("trace_id", "n_spans", "policy", "verdict")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_calls_conserve_halves(spark, some_spans, tmp_path):
    got = _run(spark, traces.calls(_stream(spark, some_spans, tmp_path, "arrival_ms")), "calls").collect()
    assert got and {r.outcome for r in got} == {"completed", "unpaired"}
    assert all((r.client is None) != (r.server is None) for r in got if r.outcome == "unpaired")


def test_a_call_waits_from_its_first_half(spark, tmp_path):
    schema = "trace_id string, span_id string, parent_span_id string, service string, kind string, status string, start_ns long, end_ns long, arrival_ms long, attrs map<string,string>, resource map<string,string>"
    half = lambda t, kind, at, status="UNSET": (t, "c" if kind == "CLIENT" else "s", "" if kind == "CLIENT" else "c", kind.lower(), kind, status, 1, 5, at, {}, {})
    # each duplicate comes within the wait of the one before; the server comes within the wait of the last, not of the first
    rows = [half("late", "CLIENT", k * 6_000) for k in (1, 2)] + [half("late", "SERVER", 17_000)] + [half("met", "SERVER", 9_000, "ERROR"), half("met", "CLIENT", 18_999)] + [half("alone", "CLIENT", 3_000), half("end", "CLIENT", 10**9)]
    got = _run(spark, traces.calls(_stream(spark, spark.createDataFrame(rows, schema), tmp_path, "arrival_ms")), "first_half").collect()
    assert sorted((r.trace_id, str(r.client), str(r.server), r.failed, r.outcome) for r in got) == [("alone", "client", "None", False, "unpaired"), ("late", "None", "server", False, "unpaired"), ("late", "client", "None", False, "unpaired"), ("met", "client", "server", True, "completed")]


def test_lines_join_under_state(spark, tmp_path):
    rows = [("a", k, line) for k, line in enumerate(["x", "  at 1", "  at 2", "y", "z", "\tat 3", "end"])] + [("b", k, line) for k, line in enumerate(["p", "q", " r", "s"])]
    df = spark.createDataFrame(rows, "file string, pos long, line string")
    got = _run(spark, stream_logs.join_multiline(_stream(spark, df, tmp_path, "pos"), "file", "pos", flush_ms=3_600_000), "lines").collect()
    assert sorted((r.key, r.body) for r in got) == [("a", "x\n  at 1\n  at 2"), ("a", "y"), ("a", "z\n\tat 3"), ("b", "p"), ("b", "q\n r")]


def test_windowed_metrics_on_a_stream(spark, tmp_path):
    table = log_table(spark, SF)
    metrics = [Metric("requests", labels=("event.type",)), Metric("took", "summary", "observe", value="took_ms")]
    end = table.limit(1).withColumn("ts_us", F.col("ts_us") + 10**13)
    got = _run(spark, stream_logs.windowed_metrics(_stream(spark, table.unionByName(end), tmp_path, "ts_us"), metrics, "1 day", "1 hour"), "metrics")
    day = 86_400_000_000
    want = log_metrics.log_metrics(table, metrics, day)
    assert sorted((r.metric, r.labels, r["count"], round(r.sum, 6)) for r in got.collect()) == sorted((r.metric, r.labels, r["count"], round(r.sum, 6)) for r in want.collect())


def test_replays_are_suppressed(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (2, "2024-01-03 00:00:00"), (3, None), (4, "2024-01-04 00:00:00")], "id long, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = _run(spark, stream_logs.not_replayed(_stream(spark, df, tmp_path, "id"), "ts", "2024-01-02", ["id"]), "replayed")
    assert sorted(r.id for r in got.collect()) in ([2, 3, 4], [2, 4])


def test_routed_batches_are_written_once(spark, tmp_path):
    df = logs.route(log_table(spark, SF), [("one", ["team-1"])]).select("log_id", "route")
    write = routed_batches(str(tmp_path / "out"))
    for _ in range(2):
        write(df, 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
