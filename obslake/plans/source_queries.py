"""Queries that read documents written from the tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_container_id, target_instance
from ..functions import maps
from ..sources import readers, writers
from .views import log_table

SQL: dict[str, str] = {}


def _json(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select("*", F.expr(sql).alias("value"))


_EVENT = """concat('{"metadata":{"name":"ev-', o_orderkey, '","uid":"u', o_orderkey, '"},"involvedObject":{"kind":"', case when o_orderkey % 3 = 0 then 'Node' else 'Pod' end, '","namespace":"ns", "name":"pod-', o_custkey, '"},"type":"',
 case when o_orderkey % 4 = 0 then 'Warning' else 'Normal' end, '","reason":"R', o_orderkey % 5, '","message":"', case when o_orderkey % 2 = 0 then 'it happened' else '' end, '",', case when o_orderkey % 7 = 0 then '"eventType":"DELETED",' else '' end, '"count":', o_orderkey % 9, '}')"""


def k8s_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.k8s_events(_json(spark, sf_dir, "orders", _EVENT))
    at = lambda m, k: F.coalesce(F.col(m)[k], F.lit(""))
    return out.groupBy("body", "severity_text", "severity_number", at("attrs", "k8s.event.reason").alias("reason"), (at("resource", "k8s.pod.name") != "").alias("of_pod")).agg(F.count("*").alias("n"), F.sum(at("attrs", "k8s.event.count").cast("long")).alias("counts"))


SQL["k8s_events"] = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'it happened' ELSE 'R' || (o_orderkey % 5) END AS body, CASE WHEN o_orderkey % 4 = 0 THEN 'warn' ELSE 'info' END AS severity_text,
  CASE WHEN o_orderkey % 4 = 0 THEN 13 ELSE 9 END AS severity_number, 'R' || (o_orderkey % 5) AS reason, o_orderkey % 3 <> 0 AS of_pod, count(*) AS n, sum(o_orderkey % 9)::BIGINT AS counts
FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL
"""

_RECORD = """concat('{"time":"t","resourceId":"/SUBSCRIPTIONS/S/resourceGroups/G', o_custkey % 4, '/providers/Microsoft.Web/sites/W","level":"', case o_orderkey % 3 when 0 then 'Error' when 1 then 'Informational' else 'Odd' end, '","category":"C', o_orderkey % 2, '","resultDescription":"done ', o_orderkey % 6, '"}')"""
_METRIC = """concat('{"time":"t","metricName":"Hits","timeGrain":"PT1M","resourceId":"/R/', o_custkey % 4, '","count":', o_orderkey % 10, ',"average":', o_orderkey % 4, '.5}')"""
_ENVELOPE = f"""case o_orderkey % 4 when 0 then concat('{{"records":[', {_RECORD}, ',', {_METRIC}, ']}}') when 1 then concat('[', {_RECORD}, ']') when 2 then {_RECORD} else 'junk' end"""


def azure_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.azure_logs(readers.azure_records(_json(spark, sf_dir, "orders", _ENVELOPE)))
    return out.groupBy("body", "severity_text", F.col("attrs")["azure.category"].alias("category"), F.col("resource")["azure.resource_group"].alias("grp"), F.col("resource")["azure.resource_type"].alias("kind")).agg(F.count("*").alias("n"))


SQL["azure_logs"] = """
SELECT 'done ' || (o_orderkey % 6) AS body, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE '' END AS severity_text, 'C' || (o_orderkey % 2) AS category,
  'g' || (o_custkey % 4) AS grp, 'microsoft.web/sites' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY ALL
"""


def azure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.azure_metrics(readers.azure_records(_json(spark, sf_dir, "orders", _ENVELOPE)))
    return out.groupBy("metric", "timegrain", "resource_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


SQL["azure_metrics"] = """
SELECT 'azure.hits.count' AS metric, 'PT1M' AS timegrain, '/r/' || (o_custkey % 4) AS resource_id, count(*) AS n, sum(o_orderkey % 10)::DOUBLE AS total FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL
UNION ALL SELECT 'azure.hits.average', 'PT1M', '/r/' || (o_custkey % 4), count(*), sum(o_orderkey % 4 + 0.5)::DOUBLE FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL
"""

_SUMMARY = """concat('{"node":{"nodeName":"n', c_nationkey, '","fs":{"usedBytes":', c_custkey, '}},"pods":[{"podRef":{"name":"p', c_custkey, '","namespace":"ns"},"process_stats":{"process_count":3},"containers":[{"name":"main","rootfs":{"usedBytes":', c_custkey % 7, '},"logs":{"usedBytes":1}},{"rootfs":{"usedBytes":9}}],"volume":[{"name":"v","capacityBytes":10,"inodes":2}]}]}')"""


def kubelet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.kubelet_summary(_json(spark, sf_dir, "customer", _SUMMARY))
    none = F.lit("")
    return out.groupBy("metric", "node", F.coalesce("container", none).alias("container"), F.coalesce("volume", none).alias("volume"), F.coalesce("fs_type", none).alias("fs_type")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_ROW = "SELECT '{0}' AS metric, 'n' || c_nationkey AS node, '{1}' AS container, '{2}' AS volume, '{3}' AS fs_type, count(*) AS n, sum({4})::DOUBLE AS total FROM customer GROUP BY ALL"
SQL["kubelet_summary"] = " UNION ALL ".join(_ROW.format(*r) for r in (("k8s.node.fs.used_bytes", "", "", "", "c_custkey"), ("k8s.pod.processes", "", "", "", "3"), ("k8s.container.fs.used_bytes", "main", "", "rootfs", "c_custkey % 7"), ("k8s.container.fs.used_bytes", "main", "", "logs", "1"), ("k8s.volume.capacity_bytes", "", "v", "", "10"), ("k8s.volume.inodes", "", "v", "", "2")))

_ENTRY = """concat('{"MESSAGE":"m', o_orderkey % 10, '","', case when o_orderkey % 2 = 0 then '_SYSTEMD_UNIT' else 'SYSLOG_IDENTIFIER' end, '":"', case o_orderkey % 3 when 0 then 'sshd.service' when 1 then 'cron' else 'other' end, '","PRIORITY":"', o_orderkey % 9, '","_PID":"12","__REALTIME_TIMESTAMP":"', o_orderkey, '"}')"""


def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.journal(_json(spark, sf_dir, "orders", _ENTRY), ["sshd.service", "cron"], max_bytes=1 << 10)
    return out.groupBy("body", "severity_text", "severity_number", F.col("resource")["service.name"].alias("service")).agg(F.count("*").alias("n"), F.sum("ts_us").alias("ts"))


SQL["journal_records"] = """
WITH x AS (SELECT *, o_orderkey % 9 AS p FROM orders WHERE o_orderkey % 3 < 2)
SELECT 'm' || (o_orderkey % 10) AS body, CASE WHEN p < 3 THEN 'fatal' WHEN p = 3 THEN 'error' WHEN p = 4 THEN 'warn' WHEN p < 7 THEN 'info' WHEN p = 7 THEN 'debug' ELSE '' END AS severity_text,
  CASE WHEN p < 3 THEN 21 WHEN p = 3 THEN 17 WHEN p = 4 THEN 13 WHEN p < 7 THEN 9 WHEN p = 7 THEN 5 ELSE 0 END AS severity_number, CASE o_orderkey % 3 WHEN 0 THEN 'sshd' ELSE 'cron' END AS service, count(*) AS n, sum(o_orderkey)::BIGINT AS ts
FROM x GROUP BY ALL
"""

_OTLP = """concat('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s', o_custkey % 5, '"}},{"key":"n","value":{"intValue":"7"}}]},"scopeSpans":[{"spans":[{"traceId":"t', o_orderkey, '","spanId":"a","name":"op","kind":3,"startTimeUnixNano":"', o_orderkey, '","endTimeUnixNano":"', o_orderkey + 5, '","status":{"code":', o_orderkey % 3, '}},{"traceId":"t', o_orderkey, '","spanId":"b","parentSpanId":"a","name":"in","kind":2,"attributes":[{"key":"ok","value":{"boolValue":true}}]}]}]}]}')"""


def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.otlp_spans(_json(spark, sf_dir, "orders", _OTLP))
    return out.groupBy("service", "name", "kind", "status", "parent_span_id", F.coalesce(F.col("attrs")["ok"], F.lit("")).alias("ok")).agg(F.count("*").alias("n"), F.coalesce(F.sum("end_ns"), F.lit(0)).alias("ends"))


SQL["otlp_spans"] = """
SELECT 's' || (o_custkey % 5) AS service, 'op' AS name, 'CLIENT' AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'UNSET' WHEN 1 THEN 'OK' ELSE 'ERROR' END AS status, '' AS parent_span_id, '' AS ok, count(*) AS n, sum(o_orderkey + 5)::BIGINT AS ends FROM orders GROUP BY ALL
UNION ALL SELECT 's' || (o_custkey % 5), 'in', 'SERVER', 'UNSET', 'a', 'true', count(*), 0 FROM orders GROUP BY ALL
"""


_OTLP_POINTS = """concat('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s', o_custkey % 5, '"}}]},"scopeMetrics":[{"scope":{"name":"sc"},"metrics":[',
  '{"name":"price","unit":"1","gauge":{"dataPoints":[{"timeUnixNano":"', o_orderkey, '","asDouble":', o_custkey, '.5}]}},',
  '{"name":"keys","sum":{"aggregationTemporality":2,"isMonotonic":true,"dataPoints":[{"timeUnixNano":"', o_orderkey, '","asInt":"', o_orderkey, '","flags":', o_orderkey % 2, '}]}},',
  '{"name":"sizes","histogram":{"aggregationTemporality":"AGGREGATION_TEMPORALITY_DELTA","dataPoints":[{"timeUnixNano":"', o_orderkey, '","count":"3","sum":1.5,"bucketCounts":["1","2"],"explicitBounds":[', o_custkey, '],"attributes":[{"key":"c","value":{"intValue":"', o_custkey, '"}}]}]}},',
  '{"name":"fine","exponentialHistogram":{"dataPoints":[{"timeUnixNano":"', o_orderkey, '","count":"', o_orderkey, '","scale":2,"positive":{"offset":-1,"bucketCounts":["', o_orderkey, '","0"]}}]}},',
  '{"name":"parts","summary":{"dataPoints":[{"timeUnixNano":"', o_orderkey, '","count":"2","sum":4,"quantileValues":[{"quantile":0.5,"value":', o_custkey, '}]}]}}]}]}]}')"""


def otlp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every shape from each order's export request."""
    # a request is much work and its row is small, so rows are dealt over tasks before requests are made of them
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition("o_orderkey")
    out = readers.otlp_points(orders.select(F.expr(_OTLP_POINTS).alias("value")))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select(
        F.col("ts_ns"), "name", "type", "is_monotonic", "temporality", "no_value", "value", "int_value", "count", "sum", listed(F.transform("bounds", lambda b: b.cast("long"))).alias("bounds"), listed("bucket_counts").alias("buckets"),
        "scale", "zero_count", listed("positive_counts").alias("positive"), F.get("quantiles", F.lit(0))["v"].alias("median"), F.col("resource")["service.name"].alias("service"), F.coalesce(F.col("labels")["c"], F.lit("")).alias("c"),
    )


SQL["otlp_points"] = """
WITH s AS (
  SELECT *, 'price' AS name, 'gauge' AS type, 'unspecified' AS temporality FROM orders UNION ALL SELECT *, 'keys', 'sum', 'cumulative' FROM orders
  UNION ALL SELECT *, 'sizes', 'histogram', 'delta' FROM orders UNION ALL SELECT *, 'fine', 'exponential', 'unspecified' FROM orders UNION ALL SELECT *, 'parts', 'summary', 'unspecified' FROM orders)
SELECT o_orderkey AS ts_ns, name, type, type = 'sum' AS is_monotonic, temporality, type = 'sum' AND o_orderkey % 2 = 1 AS no_value, CASE type WHEN 'gauge' THEN o_custkey + 0.5::DOUBLE WHEN 'sum' THEN o_orderkey::DOUBLE END AS value,
  CASE type WHEN 'sum' THEN o_orderkey END AS int_value, CASE type WHEN 'histogram' THEN 3 WHEN 'exponential' THEN o_orderkey WHEN 'summary' THEN 2 END AS count, CASE type WHEN 'histogram' THEN 1.5::DOUBLE WHEN 'summary' THEN 4::DOUBLE END AS sum,
  CASE type WHEN 'histogram' THEN o_custkey::VARCHAR ELSE '' END AS bounds, CASE type WHEN 'histogram' THEN '1,2' ELSE '' END AS buckets, CASE type WHEN 'exponential' THEN 2 END AS scale, CASE type WHEN 'exponential' THEN 0 END AS zero_count,
  CASE type WHEN 'exponential' THEN o_orderkey || ',0' ELSE '' END AS positive, CASE type WHEN 'summary' THEN o_custkey::DOUBLE END AS median, 's' || (o_custkey % 5) AS service, CASE type WHEN 'histogram' THEN o_custkey::VARCHAR ELSE '' END AS c
FROM s
"""


def log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("o_orderkey").cast("string"))
    path = F.concat(F.lit("/var/log/"), F.when(F.col("o_orderkey") % 3 == 0, "pods/web-").otherwise("app/w-"), (F.col("o_custkey") % 5).cast("string"), F.lit("_team-"), (F.col("o_orderkey") % 4).cast("string"), F.lit("_main-"), h, h, F.lit(".log"))
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(path.alias("path"))
    sources = [readers.LogSource(("/var/log/pods/*",), ("*_team-3_*",), {"from": "pods"}, (r"web-(?P<replica>\d)",)), readers.LogSource(("*.log",), (), {"from": "rest"}, (), (), ("team-2",))]
    out = readers.claimed(files, sources)
    return out.groupBy("source", F.col("resource")["from"].alias("origin"), F.coalesce(F.col("resource")["replica"], F.lit("")).alias("replica")).agg(F.count("*").alias("n"))


SQL["log_sources"] = """
WITH x AS (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 3 AS mine FROM orders)
SELECT CASE WHEN mine THEN 0 ELSE 1 END AS source, CASE WHEN mine THEN 'pods' ELSE 'rest' END AS origin, CASE WHEN mine THEN (o_custkey % 5)::VARCHAR ELSE '' END AS replica, count(*) AS n
FROM x WHERE mine OR o_orderkey % 4 <> 2 GROUP BY ALL
"""


def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.assign_size_chunks(log_table(spark, sf_dir), ["pod"], F.octet_length("body"), ["ts_us", "log_id"], 2000)
    return out.groupBy("pod", "chunk").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))


SQL["size_chunks"] = """
WITH x AS (SELECT pod, strlen(body) AS b, sum(strlen(body)) OVER (PARTITION BY pod ORDER BY ts_us, log_id ROWS UNBOUNDED PRECEDING) AS upto FROM v_logs),
cut AS (SELECT pod, b, (upto - b) // 2000 AS first, upto > ((upto - b) // 2000 + 1) * 2000 AS crosses FROM x)
SELECT pod, (2 * first + crosses::INTEGER)::BIGINT AS chunk, count(*) AS n, sum(b)::BIGINT AS bytes FROM cut GROUP BY ALL
"""


def tapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.tap(log_table(spark, sf_dir), [("k8s.name*", "team-?"), ("*.pod.*", "pod-1*")], 25, ["log_id"])
    return out.select("log_id", "pod")


SQL["tapped"] = "SELECT log_id, pod FROM v_logs WHERE starts_with(pod, 'pod-1') AND ('0x' || substr(md5(log_id::VARCHAR), 1, 8))::BIGINT % 10000 < 2500"


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical keys there and back, container ids, instances of URLs."""
    m = F.create_map(F.lit("b"), F.col("pod"), F.lit("a"), F.concat(F.lit('x"\\'), F.col("namespace")), F.lit("none"), F.lit(""))
    key = maps.label_key(m)
    back = maps.label_set(key)
    return log_table(spark, sf_dir).select("log_id", key.alias("key"), back["a"].alias("a"), F.size(back).alias("n"), normalize_container_id(F.concat(F.lit(" docker://"), F.col("container_id"), F.lit(" "))).alias("cid"), target_instance(F.concat(F.lit("http://[fe80::1]:"), F.col("user_id").cast("string"), F.lit("/m"))).alias("instance"))


SQL["label_keys"] = """
SELECT log_id, '{a="x\\"\\\\' || namespace || '", b="' || pod || '"}' AS key, 'x"\\' || namespace AS a, 2 AS n, container_id AS cid, '[fe80::1]:' || user_id AS instance FROM v_logs
"""
QUERIES = {name: globals()[name] for name in SQL}
