"""OTLP points of every shape in one frame."""

from __future__ import annotations

import json

from obslake.sources import readers


def test_shapes(spark):
    at = {"startTimeUnixNano": "1", "timeUnixNano": "2", "attributes": [{"key": "k", "value": {"boolValue": True}}, {"key": "n", "value": {}}]}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [at | {"asDouble": 1.5}, {"asInt": "9007199254740993"}]}},
        {"name": "s", "unit": "By", "description": "d", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [{"asInt": "7", "flags": 1}]}},
        {"name": "h", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_CUMULATIVE", "dataPoints": [{"count": "3", "sum": 2.0, "min": 0.1, "max": 1.0, "bucketCounts": ["1", "2"], "explicitBounds": [0.5]}]}},
        {"name": "e", "exponentialHistogram": {"aggregationTemporality": 9, "dataPoints": [{"count": "4", "scale": -1, "zeroCount": "1", "positive": {"offset": 2, "bucketCounts": ["1", "1"]}, "negative": {"bucketCounts": ["1"]}}]}},
        {"name": "q", "summary": {"dataPoints": [{"count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}, {"quantile": 1, "value": 2}]}]}},
        {"name": "none", "gauge": {}}, {"name": "bare"},
    ]
    request = {"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}]}, "scopeMetrics": [{"scope": {"name": "sc"}, "metrics": metrics}, {}]}, {}]}
    rows = spark.createDataFrame([(json.dumps(request),), ("{not json",), (None,), ("{}",)], "value string")
    got = {}
    for r in readers.otlp_points(rows).collect():
        got.setdefault(r.name, []).append(r)
    assert {n: len(p) for n, p in got.items()} == {"g": 2, "s": 1, "h": 1, "e": 1, "q": 1}
    assert all(r.resource == {"service.name": "x"} and r.scope == "sc" for p in got.values() for r in p)
    a, b = sorted(got["g"], key=lambda r: r.value)
    assert (a.type, a.start_ns, a.ts_ns, a.labels, a.value, a.int_value, a.no_value) == ("gauge", 1, 2, {"k": "true"}, 1.5, None, False)
    assert (b.value, b.int_value, b.labels, b.ts_ns) == (float(2**53), 9007199254740993, {}, None)
    s, h, e, q = got["s"][0], got["h"][0], got["e"][0], got["q"][0]
    assert (s.type, s.temporality, s.is_monotonic, s.no_value, s.unit, s.description, s["count"]) == ("sum", "delta", True, True, "By", "d", None)
    assert (h.type, h.temporality, h["count"], h.sum, h.min, h.max, h.bounds, h.bucket_counts, h.value) == ("histogram", "cumulative", 3, 2.0, 0.1, 1.0, [0.5], [1, 2], None)
    assert (e.type, e.temporality, e.scale, e.zero_count, e.positive_offset, e.positive_counts, e.negative_offset, e.negative_counts, e.sum) == ("exponential", "unspecified", -1, 1, 2, [1, 1], None, [1], None)
    assert q.type == "summary" and [tuple(x) for x in q.quantiles] == [(0.5, 1.0), (1.0, 2.0)]
