"""Request, error and duration metrics of spans, and cumulative series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SPAN_BOUNDS, bucket_index, cut_utf8, span_nanos, span_size

BUILT_IN = ("service", "name", "kind", "status")


def dimension(key: str) -> Column:
    """Value of an extra dimension: the span's attribute, else the resource's, else empty; at most 256 bytes."""
    return cut_utf8(F.coalesce(F.col("attrs")[key], F.col("resource")[key], F.lit("")))


def bucket_counts(seconds: Column, bounds: tuple[float, ...], when: Column | None = None) -> Column:
    """Aggregate: counts of each bucket, the last being above all bounds; rows outside `when` count nowhere."""
    index = bucket_index(seconds, bounds)
    ok = when if when is not None else F.lit(True)
    return F.array(*(F.count_if(ok & (index == k)) for k in range(len(bounds) + 1)))


def span_red(spans: DataFrame, dims: tuple[str, ...] = (), bounds: tuple[float, ...] = SPAN_BOUNDS, window: str | None = None) -> DataFrame:
    """Calls, bytes, duration sum in nanoseconds and duration histogram for each service, span name, kind, status and dimension.

    Dimensions that are named like a built-in one are dropped. window: a duration, for one row for each tumbling window of column ts.
    Works on streams with a watermark on ts.
    """
    keys = [F.col(k) for k in BUILT_IN] + [dimension(d).alias(d.replace(".", "_")) for d in dims if d not in BUILT_IN]
    if window:
        keys.append(F.window("ts", window).alias("window"))
    nanos = span_nanos("start_ns", "end_ns")
    return spans.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum(span_size("name", "attrs")).alias("bytes"),
        F.sum(nanos).alias("duration_ns"),
        bucket_counts(nanos / 1e9, bounds).alias("buckets"),
    )


def exemplars(spans: DataFrame, keys: tuple[str, ...] = ("service",), bounds: tuple[float, ...] = SPAN_BOUNDS) -> DataFrame:
    """For each key and duration bucket the latest span with a trace id (ties: the larger span id)."""
    bucket = bucket_index(span_nanos("start_ns", "end_ns") / 1e9, bounds).alias("bucket")
    known = spans.filter(F.coalesce("trace_id", F.lit("")) != "")
    latest = F.max_by(F.struct("trace_id", "span_id", "end_ns"), F.struct("end_ns", "span_id"))
    return known.groupBy(*keys, bucket).agg(latest.alias("e")).select(*keys, "bucket", "e.*")


def cumulative(points: DataFrame, keys: list[str], ts: str, value: str, stale_after: int) -> DataFrame:
    """points with start_ts and total: running sums per series, begun anew after stale_after without a point (0: never).

    Each series is summed in the order of its points by a window over the series, which spills.
    """
    if stale_after < 0:
        raise ValueError("stale_after is negative")
    series = Window.partitionBy(*keys).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(series)
    fresh = F.lit(False) if stale_after == 0 else F.coalesce(gap > stale_after, F.lit(False))
    out = points.withColumn("_fresh", fresh.cast("int")).withColumn("incarnation", F.sum("_fresh").over(series))
    own = Window.partitionBy(*keys, "incarnation").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("start_ts", F.min(ts).over(own)).withColumn("total", F.sum(value).over(own)).drop("_fresh")


def zero_baseline(points: DataFrame, keys: list[str], ts: str, total: str, step: int) -> DataFrame:
    """points and, two steps and one before the first of each series, points of zero; start_ts lies three steps before the first."""
    first = points.groupBy(*keys).agg(F.min(ts).alias("first"))
    zeros = first.select(*keys, F.explode(F.array(F.col("first") - 2 * step, F.col("first") - step)).alias(ts), F.lit(0).cast(points.schema[total].dataType).alias(total), (F.col("first") - 3 * step).alias("start_ts"))
    own = points.join(first, keys).select(*keys, ts, total, (F.col("first") - 3 * step).alias("start_ts"))
    return own.unionByName(zeros)


def cap_cardinality(points: DataFrame, keys: list[str], group: list[str], ts: str, most: int) -> DataFrame:
    """points of the first `most` series of each group by first appearance (ties by key); the others are refused."""
    series = points.groupBy(*group, *keys).agg(F.min(ts).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_first", *keys))
    kept = series.withColumn("_rank", rank).filter(F.col("_rank") <= most).select(*group, *keys)
    return points.join(kept, [*group, *keys], "left_semi")
