"""Logs on streams: lines put together under keyed state, replay suppression, windowed metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import log_metrics
from ..operators.logs import CONTINUES


def join_multiline(lines: DataFrame, key: str, order: str, flush_ms: int = 1_000, continues: str = CONTINUES, max_lines: int = 512) -> DataFrame:
    """(key, body, first, last, n_lines) of lines (key string, order long, line string): a record ends where a line doesn't continue it.

    The open record of each key is its state. It is flushed when its key has been silent for flush_ms, or holds max_lines lines.
    """
    pattern = re.compile(continues)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        text, first, last, n = state.get if state.exists else ("", 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], text, first, last, n)], columns=["key", "body", "first", "last", "n_lines"])
            return
        rows = pd.concat(list(batches)).sort_values("at")
        for at, line in zip(rows["at"], rows["line"]):
            if n and pattern.search(line) and n < max_lines:
                text, last, n = f"{text}\n{line}", int(at), n + 1
            else:
                if n:
                    done.append((k[0], text, first, last, n))
                text, first, last, n = line, int(at), int(at), 1
        state.update((text, first, last, n))
        state.setTimeoutDuration(flush_ms)
        yield pd.DataFrame(done, columns=["key", "body", "first", "last", "n_lines"])

    named = lines.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col("line"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, body string, first long, last long, n_lines int", "text string, first long, last long, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def not_replayed(rows: DataFrame, ts: str, replay_from: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Rows from replay_from on, and those without a time, once for each key."""
    kept = rows.filter(F.col(ts).isNull() | (F.col(ts) >= F.lit(replay_from).cast("timestamp")))
    return kept.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_metrics(logs: DataFrame, metrics: list[log_metrics.Metric], window: str, lateness: str) -> DataFrame:
    """(metric, window, labels, resource_labels, sum, count, min, max) of each tumbling window when the watermark has passed it."""
    seen = log_metrics.observations(logs, metrics).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)
    v = F.col("value")
    return seen.groupBy("metric", F.window("ts", window).alias("window"), "labels", "resource_labels").agg(F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
