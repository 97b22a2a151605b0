"""Metrics derived from log records: counters, gauges, histograms, summaries.

All metrics are read in one pass: a record gives an array of observations, which is exploded and aggregated once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.scalars import bucket_index, cut_utf8
from ..functions.selectors import SEVERITY, Record, match, resolve, resolve_number
from .logs import FIELDS, settled, with_fields

#: Default histogram bounds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
KINDS = {"counter": ("add",), "gauge": ("set", "inc", "dec", "add", "sub", "min", "max", "avg", "sum", "count"), "histogram": ("observe",), "summary": ("observe",)}
MAX_SERIES, MAX_SLOTS = 10_000, 150_000
_TEMPLATE = re.compile(r"^(?:([A-Za-z_][\w.]*)=)?(\$?)([\w.\-]+)(?:\((.+)\)|(/.*/))?$", re.S)


def label(template: str, record: Record, prefix: str = "") -> tuple[str, Column]:
    """(name, value) of a label template: key, name=$key, name=literal, with (mask) or /pattern/replacement/ behind a key.

    A mask keeps the value's characters where it has `_` and puts its own elsewhere; what is longer than the mask goes,
    and an empty value stays empty.
    """
    m = _TEMPLATE.match(template)
    if not m:
        raise ValueError(f"not a label: {template!r}")
    name, dollar, key, mask, replace = m.groups()
    value = resolve(record, key) if dollar or not name else F.lit(key)
    if mask:
        own = lambda k: F.coalesce(F.nullif(F.substring(value, k + 1, 1), F.lit("")), F.lit("_"))
        value = F.when(value == "", "").otherwise(F.concat(*(own(k) if c == "_" else F.lit(c) for k, c in enumerate(mask))))
    if replace:
        pattern, replacement, rest = re.split(r"(?<!\\)/", replace[1:])
        if rest:
            raise ValueError(f"not a replacement: {replace!r}")
        value = F.regexp_replace(value, pattern.replace(r"\/", "/"), re.sub(r"\$\{(\d+)\}", r"$\1", replacement.replace(r"\/", "/")))
    return prefix + (name or key), cut_utf8(value)


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str = "counter"
    action: str = "add"
    value: str = "1"
    value_regexp: str = ""
    exact: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    resource_labels: tuple[str, ...] = ()
    bounds: tuple[float, ...] = BOUNDS
    max_series: int = MAX_SERIES

    def observed(self, record: Record) -> Column:
        """The value that a record gives: one, a key's number, or what the pattern captures; null if there is none."""
        source = F.lit("1") if self.value == "1" else resolve(record, self.value)
        if self.value_regexp:
            source = resolve(record, self.value if self.value != "1" else "__line__")
            group = 1 if re.compile(self.value_regexp).groups else 0
            source = F.nullif(F.regexp_extract(source, self.value_regexp, group), F.lit(""))
            return source.try_cast("double")
        return F.lit(1.0) if self.value == "1" else resolve_number(record, self.value)


def validate(metrics: list[Metric]) -> None:
    """Fails on metrics that can't work together, before a job starts."""
    seen: dict[str, Metric] = {}
    for m in metrics:
        if m.action not in KINDS.get(m.kind, ()):
            raise ValueError(f"{m.name}: {m.kind} has no action {m.action}")
        if m.kind == "histogram" and any(t.split("=")[0] == "le" for t in m.labels):
            raise ValueError(f"{m.name}: a histogram's label can't be named le")
        if any(SEVERITY in t for t in m.labels) or m.value == SEVERITY:
            raise ValueError(f"{m.name}: {SEVERITY} is for matching only")
        if m.kind == "histogram" and m.max_series * (len(m.bounds) + 1) > MAX_SLOTS:
            raise ValueError(f"{m.name}: more than {MAX_SLOTS} buckets")
        if m.kind in ("histogram", "summary") and m.value == "1" and not m.value_regexp:
            raise ValueError(f"{m.name}: a {m.kind} needs a value")
        other = seen.setdefault(m.name, m)
        if (other.kind, other.action, other.bounds, other.max_series) != (m.kind, m.action, m.bounds, m.max_series):
            raise ValueError(f"{m.name} is declared twice in different ways")


def observations(logs: DataFrame, metrics: list[Metric], ts_us: str = "ts_us", keep: tuple[str, ...] = (), record: Record | None = None) -> DataFrame:
    """(metric, labels, resource_labels, ts_us, value) of every record and metric that match; labels are canonical keys. NaN and infinity don't count."""
    validate(metrics)
    if record is None:
        logs = with_fields(logs)
        record = Record.default(FIELDS)
    rows = []
    for m in metrics:
        hit = match(record, list(m.exact), list(m.regex)) if m.exact or m.regex else F.lit(True)
        sets = [maps.label_key(F.create_map(*(x for t in ts for x in _pair(label(t, record))))) if ts else F.lit("{}") for ts in (m.labels, m.resource_labels)]
        rows.append(F.when(hit, F.struct(F.lit(m.name).alias("metric"), sets[0].alias("labels"), sets[1].alias("resource_labels"), m.observed(record).alias("value"))))
    some = F.filter(F.array(*rows), lambda r: r.isNotNull())
    out = logs.select(*keep, F.col(ts_us).alias("ts_us"), F.inline(some))
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def _pair(x: tuple[str, Column]) -> tuple[Column, Column]:
    return F.lit(x[0]), x[1]


def log_metrics(logs: DataFrame, metrics: list[Metric], window_us: int, order: str = "log_id", record: Record | None = None) -> DataFrame:
    """One row for each metric, window, label set: value (by the metric's action), count, sum, and buckets of histograms.

    Counters and histograms hold the window's increase. Gauges: set takes the last value (by time, then order), inc and dec count,
    add and sub sum, the others aggregate.
    """
    seen = observations(logs, metrics, keep=(order,), record=record).withColumn("window", F.expr(f"ts_us div {window_us}"))
    by_kind, buckets = F.lit(None).cast("double"), F.lit(None).cast("array<bigint>")
    v = F.col("value")
    actions = {
        "add": F.sum(v), "sub": -F.sum(v), "inc": F.count(v).cast("double"), "dec": -F.count(v).cast("double"), "set": F.max_by(v, F.struct("ts_us", order)),
        "min": F.min(v), "max": F.max(v), "avg": F.avg(v), "sum": F.sum(v), "count": F.count(v).cast("double"), "observe": F.sum(v),
    }
    wanted = {m.name: m for m in metrics}
    used = {m.action for m in metrics}
    bounds = sorted({m.bounds for m in wanted.values() if m.kind == "histogram"})
    counts = {b: F.array(*(F.count_if(bucket_index(v, b) == k) for k in range(len(b) + 1))).alias(f"_b{n}") for n, b in enumerate(bounds)}
    out = seen.groupBy("metric", "window", "labels", "resource_labels").agg(F.count(v).alias("count"), F.sum(v).alias("sum"), *(actions[a].alias(f"_{a}") for a in sorted(used)), *counts.values())
    for m in wanted.values():
        by_kind = F.when(F.col("metric") == m.name, F.col(f"_{m.action}")).otherwise(by_kind)
        if m.kind == "histogram":
            buckets = F.when(F.col("metric") == m.name, F.col(f"_b{bounds.index(m.bounds)}")).otherwise(buckets)
    return out.select("metric", "window", "labels", "resource_labels", by_kind.alias("value"), "count", "sum", buckets.alias("buckets"))


def running_gauge(windows: DataFrame) -> DataFrame:
    """Windows of an add/sub/inc/dec gauge with `total`, the value after each."""
    w = Window.partitionBy("metric", "labels", "resource_labels").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("total", F.sum("value").over(w))


def held(windows: DataFrame, keys: list[str], window: str, value: str, longest: int | None = None) -> DataFrame:
    """A row for each window from a series' first to the last of all, the value repeated until there is a new one; at most `longest` times."""
    # settled: both readers see the same columns, so what the windows are made from is shuffled once for the two
    windows = settled(windows.select(*keys, window, value))
    series = Window.partitionBy(*keys).orderBy(window)
    last = windows.agg(F.max(window).alias("_last"))
    known = windows.withColumn("_next", F.lead(window).over(series)).crossJoin(last)
    until = F.greatest(F.col(window), F.coalesce(F.col("_next") - 1, F.col("_last")))
    spine = known.select(*keys, F.col(window).alias("_own"), value, F.explode(F.sequence(window, until)).alias(window))
    spine = spine.withColumn(value, F.when(F.col("_own") == F.col(window), F.col(value)))
    held_over = series.rowsBetween(Window.unboundedPreceding if longest is None else -longest, 0)
    return spine.select(*keys, window, F.last(value, ignorenulls=True).over(held_over).alias(value))


def expired(windows: DataFrame, keys: list[str], window: str, max_age: int, gone_after: int) -> DataFrame:
    """Windows of each series on an unbroken spine with state: live, zeroed past max_age idle windows, and none after gone_after more."""
    filled = held(windows.withColumn("_seen", F.col(window)), keys, window, "_seen")
    idle = F.col(window) - F.col("_seen")
    return filled.filter(idle <= max_age + gone_after).select(*keys, window, F.when(idle > max_age, "zeroed").otherwise("live").alias("state"))
