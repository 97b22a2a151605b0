"""Traces on streams.

Calls are paired under keyed state: the half that comes first sets a timer, which nothing that follows moves; the watermark fires it, so
results don't depend on when a batch runs. Tail decisions are the batch operators' own expressions over session windows of arrival: a trace
is a session that closes when nothing has arrived for the wait, with one aggregated row of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import late, sampling, service_graph


def _timed(spans: DataFrame, lateness: str) -> DataFrame:
    return spans.withColumn("arrival_ts", F.timestamp_millis("arrival_ms")).withWatermark("arrival_ts", lateness)


_CALL = ["trace_id", "key", "client", "server", "failed", "client_ns", "server_ns", "outcome"]
_CALL_SCHEMA = "trace_id string, key string, client string, server string, failed boolean, client_ns long, server_ns long, outcome string"


def calls(spans: DataFrame, wait_ms: int = 10_000, lateness: str = "10 seconds") -> DataFrame:
    """(trace_id, key, client, server, failed, client_ns, server_ns, outcome) of calls: at once when both halves are there, else when the wait is over.

    The wait runs from the arrival of the first half; duplicates of a half replace it and don't prolong it. A half that comes when its
    call is over begins another. A side that never came is null.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        # arrival of the first half, then its side, service, failure and duration
        held = state.get if state.exists else None

        def over() -> None:
            _, side, service, failed, ns = held
            done.append((*k, service, None, failed, ns, None, "unpaired") if side == "client" else (*k, None, service, failed, None, ns, "unpaired"))

        if state.hasTimedOut:
            over()
            held = None
        else:
            rows = pd.concat(list(batches)).sort_values(["arrival_ms", "span_id"])
            for at, side, service, failed, ns in zip(*(rows[c].tolist() for c in ("arrival_ms", "side", "service", "failed", "ns"))):
                if held and at >= held[0] + wait_ms:
                    over()
                    held = None
                if held and side != held[1]:
                    c, s = ((service, ns), held[2::2]) if side == "client" else (held[2::2], (service, ns))
                    done.append((*k, c[0], s[0], bool(failed or held[3]), c[1], s[1], "completed"))
                    held = None
                else:
                    held = (held[0] if held else int(at), side, service, bool(failed), int(ns))
            if held and held[0] + wait_ms <= state.getCurrentWatermarkMs():
                over()
                held = None
        if held:
            state.update(held)
            state.setTimeoutTimestamp(held[0] + wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=_CALL).astype({"client_ns": "Int64", "server_ns": "Int64"})

    known = service_graph.halves(_timed(spans, lateness)).filter("side is not null and not unkeyable")
    half = known.select("trace_id", "key", "side", "service", F.coalesce(F.col("status") == "ERROR", F.lit(False)).alias("failed"), service_graph.span_nanos("start_ns", "end_ns").alias("ns"), "arrival_ms", "span_id", "arrival_ts")
    return half.groupBy("trace_id", "key").applyInPandasWithState(step, _CALL_SCHEMA, "first long, side string, service string, failed boolean, ns long", "append", GroupStateTimeout.EventTimeTimeout)


def decisions(spans: DataFrame, policies: list[sampling.Policy], wait: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """(trace_id, n_spans, policy, verdict) of traces, each when its session closes. Spans after that begin a session of their own."""
    asked = [c.alias(f"p{k}_{a}") for k, p in enumerate(policies) for a, c in p.aggregates.items()]
    traces = _timed(spans, lateness).groupBy(F.session_window("arrival_ts", wait), "trace_id").agg(F.count("*").alias("n_spans"), *asked)
    opinions = [F.when(p.verdict(f"p{k}_").isNotNull(), F.struct(F.lit(p.name).alias("policy"), p.verdict(f"p{k}_").alias("verdict"))) for k, p in enumerate(policies)]
    first = F.coalesce(*opinions, F.struct(F.lit("").alias("policy"), F.lit("drop").alias("verdict")))
    return traces.select("trace_id", "n_spans", first.alias("d")).select("trace_id", "n_spans", "d.policy", "d.verdict")


_SETTLED = ["trace_id", "start_ms", "end_ms", "n_spans", "policy", "verdict", "late", "spans"]
_SETTLED_SCHEMA = "trace_id string, start_ms long, end_ms long, n_spans long, policy string, verdict string, late boolean, spans array<string>"


class _Verdicts(StatefulProcessor):
    """A trace's remembered verdict, and a timer that forgets it."""

    def __init__(self, ttl_ms: int, longest_ms: int) -> None:
        self.ttl_ms, self.longest_ms = ttl_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "until long, policy string, verdict string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("start_ms")
        was = memory = tuple(self.memory.get()) if self.memory.exists() else None
        done: list[tuple] = []
        for start, end, n, policy, verdict, held in zip(*(came[c].tolist() for c in ("start_ms", "end_ms", "n_spans", "policy", "verdict", "spans"))):
            memory, policy, verdict, is_late = late.settle(memory, int(start), int(end), policy, verdict, self.ttl_ms)
            done.append((*key, int(start), int(end), int(n), policy, verdict, is_late, list(held)))
        if memory != was:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.memory.update(memory)
            # one that is due already fires with the next batch
            self.handle.registerTimer(max(memory[0] + self.longest_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(done, columns=_SETTLED)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        yield pd.DataFrame([], columns=_SETTLED)

    def close(self) -> None:
        pass


def settled(spans: DataFrame, policies: list[sampling.Policy], wait: str = "5 seconds", ttl_ms: int = 30_000, lateness: str = "10 seconds", carry: tuple[str, ...] = (), longest_ms: int = 600_000) -> DataFrame:
    """The sessions of late.settled_sessions() on a stream: each trace's first session is decided, later ones within ttl_ms of that share its verdict.

    A verdict is one row of state under its trace, removed by a timer. The timer runs longest_ms beyond the time to live, since a session that began in time is only
    known when it ends; sessions longer than that count as fresh. late.kept() gives the spans. The session needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), the only one under which a stateful processor may follow an aggregation.
    """
    # dealt out by another key in between: two operators of one task would share the thread's state store
    sessions = late.trace_sessions(_timed(spans, lateness), policies, wait, carry).repartition("end_ms")
    return sessions.groupBy("trace_id").transformWithStateInPandas(_Verdicts(ttl_ms, longest_ms), _SETTLED_SCHEMA, "Append", "EventTime")
