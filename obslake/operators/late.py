"""Spans that come after their trace was decided.

A trace is decided when nothing of it has arrived for the wait: a session. Spans that arrive later are a session of their own, which isn't decided again while the first verdict is
remembered (a time to live from the decision, which late sessions don't prolong): they share its fate. After that the trace is a fresh one. Sessions are
aggregated by the same expressions in batches and on streams, and both settle them with one step function; see streaming.traces.settled().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import _folded
from .sampling import Policy

#: (remembered until, policy, verdict)
Memory = tuple[int, str, str]


def trace_sessions(spans: DataFrame, policies: list[Policy], wait: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(trace_id, start_ms, end_ms, n_spans, policy, verdict, spans) of each session of spans with an arrival_ts, for batches and, with a watermark, streams.

    end_ms is the last arrival and the wait: when the session is decided. spans: the columns of `carry` of each span as JSON, empty without any; they are held as
    long as the session, like the trace that a collector buffers. The first policy with an opinion decides, and none drops.
    """
    asked = [c.alias(f"p{k}_{a}") for k, p in enumerate(policies) for a, c in p.aggregates.items()]
    held = F.collect_list(F.to_json(F.struct(*carry))) if carry else F.array().cast("array<string>")
    out = spans.groupBy(F.session_window("arrival_ts", wait).alias("session"), "trace_id").agg(F.count("*").alias("n_spans"), held.alias("spans"), *asked)
    opinions = [F.when(p.verdict(f"p{k}_").isNotNull(), F.struct(F.lit(p.name).alias("policy"), p.verdict(f"p{k}_").alias("verdict"))) for k, p in enumerate(policies)]
    first = F.coalesce(*opinions, F.struct(F.lit("").alias("policy"), F.lit("drop").alias("verdict")))
    ends = (F.unix_millis(F.col("session.start")).alias("start_ms"), F.unix_millis(F.col("session.end")).alias("end_ms"))
    return out.select("trace_id", *ends, "n_spans", first.alias("d"), "spans", "session").select("trace_id", "start_ms", "end_ms", "n_spans", "d.policy", "d.verdict", "spans", "session")


def settle(memory: Memory | None, start_ms: int, end_ms: int, policy: str, verdict: str, ttl_ms: int) -> tuple[Memory, str, str, bool]:
    """What is remembered after a session, and its policy, verdict and whether it was late."""
    if memory and start_ms < memory[0]:
        return memory, memory[1], memory[2], True
    return (end_ms + ttl_ms, policy, verdict), policy, verdict, False


def settled_sessions(sessions: DataFrame, ttl_ms: int) -> DataFrame:
    """trace_sessions() with the policy and verdict that hold, and `late`: another session's verdict, remembered for ttl_ms."""

    def begin() -> Callable:
        memory: Memory | None = None

        def step(start: int, end: int, policy: str, verdict: str) -> tuple[str, str, bool]:
            nonlocal memory
            memory, *found = settle(memory, start, end, policy, verdict, ttl_ms)
            return tuple(found)

        return step

    rows = sessions.drop("session").withColumnsRenamed({"policy": "_policy", "verdict": "_verdict"})
    out = _folded(rows, "trace_id", ["start_ms"], ["start_ms", "end_ms", "_policy", "_verdict"], [("policy", T.StringType()), ("verdict", T.StringType()), ("late", T.BooleanType())], begin)
    return out.select("trace_id", "start_ms", "end_ms", "n_spans", "policy", "verdict", "late", "spans")


def kept(settled: DataFrame, schema: str) -> DataFrame:
    """The carried spans of sampled sessions, with `late`; schema: DDL of what was carried."""
    rows = settled.filter("verdict = 'sample'").select("late", F.explode("spans").alias("span"))
    return rows.select(F.from_json("span", schema).alias("s"), "late").select("s.*", "late")
