"""Where a user's own functions come in. A hook that fails on a row leaves the row as it was."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log_metrics import Metric


def transformed(df: DataFrame, *transforms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df through functions from DataFrame to DataFrame, in order."""
    for t in transforms:
        df = t(df)
    return df


def mapped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """df through a function over batches of rows; rows that it leaves out are dropped. Where it fails, a batch stays as it was, unless a schema of its own is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = fn(batch.copy())
            except Exception:  # noqa: BLE001  a user's function
                if schema:
                    raise
                out = batch
            yield out

    return df.mapInPandas(run, schema or df.schema)


def with_emitted(observations: DataFrame, emitted: DataFrame, metrics: list[Metric]) -> DataFrame:
    """observations and what a transform emits (metric, labels, resource_labels, ts_us, value). A metric that isn't declared fails the job."""
    known = F.col("metric").isin([m.name for m in metrics])
    checked = emitted.withColumn("metric", F.when(known, F.col("metric")).otherwise(F.raise_error(F.concat(F.lit("metric isn't declared: "), F.col("metric")))))
    return observations.unionByName(checked, allowMissingColumns=True)


def admitted(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that the condition doesn't refuse; no answer admits."""
    return df.filter(F.coalesce(condition, F.lit(True)))


def parsed_lines(logs: DataFrame, fn: Callable[[str], dict | None]) -> DataFrame:
    """logs with body, severity_text and ts_us replaced where fn(body) gives them; None or an error keeps the record."""

    @F.pandas_udf("body string, severity_text string, ts_us long")
    def run(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            try:
                found = fn(line) or {}
            except Exception:  # noqa: BLE001  a user's function
                found = {}
            out.append((found.get("body"), found.get("severity_text"), found.get("ts_us")))
        return pd.DataFrame(out, columns=["body", "severity_text", "ts_us"]).astype({"ts_us": "Int64"})

    staged = logs.withColumn("_p", run("body"))
    return staged.withColumns({c: F.coalesce(f"_p.{c}", c) for c in ("body", "severity_text", "ts_us")}).drop("_p")


def _verdict(said: bool | None) -> str | None:
    return None if said is None else "sample" if said else "veto"


def script_folds(spans: DataFrame, begin: Callable[[], Any], step: Callable[[Any, dict], Any], end: Callable[[Any], bool | None]) -> DataFrame:
    """(trace_id, verdict) of a script that reads a trace span by span: step(state, span) from begin(), then end(state) gives sample (True), veto (False) or null.

    A task reads its spans in order of trace and holds one state, so a trace may have any number of spans. An error of the script makes its trace's verdict null.
    """
    rest = [c for c in spans.columns if c != "trace_id"]
    texts = spans.select("trace_id", F.to_json(F.struct(*rest)).alias("span"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        done: list[tuple[str | None, str | None]] = []
        for trace, own in groupby(rows, key=lambda r: r[0]):
            try:
                state = begin()
                for _, text in own:
                    state = step(state, json.loads(text))
                done.append((trace, _verdict(end(state))))
            except Exception:  # noqa: BLE001  a user's function; groupby passes over the rest of its trace
                done.append((trace, None))
            if len(done) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["trace_id", "verdict"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["trace_id", "verdict"])

    # by a hash, so that the exchange stays where the spans come from a join on trace_id
    return texts.repartition(F.xxhash64("trace_id")).sortWithinPartitions("trace_id").mapInArrow(run, "trace_id string, verdict string")


def script_verdicts(spans: DataFrame, fn: Callable[[list[dict]], bool | None]) -> DataFrame:
    """(trace_id, verdict): fn over all of a trace's spans gives sample (True), veto (False) or null; an error is null.

    A worker holds one trace at a time. A script that needn't have the spans together is better given to script_folds().
    """
    
    def add(held: list[dict], span: dict) -> list[dict]:
        held.append(span)
        return held

    return script_folds(spans, list, add, fn)
