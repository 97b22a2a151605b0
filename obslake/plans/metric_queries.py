"""Queries over samples and readings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples as ops
from ..operators import usage
from ..operators.samples import RelabelRule, SeriesRule, Splitter
from .views import attributes, view

SQL: dict[str, str] = {}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = view(spark, sf_dir, "v_samples").withColumn("ts_ms", F.when(F.col("pos") % 2 == 0, F.col("scrape_ms") + F.col("pos")).otherwise(0))
    return attributes(table, "labels", le="le", namespace="namespace", pod="pod", node="user_id")


_ARRAY = "array<string>"


def _text(name: str):
    return F.array_join(F.col(name).cast(_ARRAY), ",").alias(name)


def series_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.filter_series(_samples(spark, sf_dir), [SeriesRule("drop", "temp.*", (("namespace", "team-1"),)), SeriesRule("keep", "temp.*|latency_.*")], [SeriesRule("drop", "latency_bucket", (("le", "5|10"),))])
    return kept.groupBy("name", "namespace").agg(F.count("*").alias("n"))


SQL["series_filter"] = """
SELECT name, namespace, count(*) AS n FROM v_samples
WHERE NOT (starts_with(name, 'temp') AND namespace = 'team-1') AND NOT (name = 'latency_bucket' AND coalesce(le, '') IN ('5', '10')) GROUP BY ALL
"""


def relabel_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.relabel_keep_drop(_samples(spark, sf_dir), [RelabelRule("keep", ("namespace", "__name__"), "team-[12];.*"), RelabelRule("drop", ("le",), "20|40"), RelabelRule("keep", ("pod",))])
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


SQL["relabel_keep_drop"] = "SELECT name, count(*) AS n, sum(value) AS total FROM v_samples WHERE namespace IN ('team-1', 'team-2') AND coalesce(le, '') NOT IN ('20', '40') GROUP BY ALL"


def malformed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.malformed(_samples(spark, sf_dir)).groupBy("role", "malformed").agg(F.count("*").alias("n"))


_BAD = "((role IN ('histogram_bucket', 'histogram_count') AND value < 0) OR (role = 'histogram_bucket' AND try_cast(replace(le, '+Inf', 'inf') AS DOUBLE) IS NULL))"
SQL["malformed_samples"] = f"SELECT role, {_BAD} AS malformed, count(*) AS n FROM v_samples GROUP BY ALL"


def point_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = ops.point_ts(F.col("ts_ms"), F.col("scrape_ms")).alias("ts_ns")
    return _samples(spark, sf_dir).select("scrape_id", "pos", ts)


SQL["point_timestamps"] = "SELECT scrape_id, pos, (scrape_ms + CASE WHEN pos % 2 = 0 THEN pos ELSE 0 END) * 1000000 AS ts_ns FROM v_samples"


def histogram_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.assemble_histograms(_samples(spark, sf_dir))
    return out.select("scrape_id", "labels", _text("bounds"), _text("bucket_counts"), "count", "sum")


SQL["histogram_assembly"] = f"""
WITH ok AS (SELECT *, try_cast(replace(le, '+Inf', 'inf') AS DOUBLE) AS bound FROM v_samples WHERE family = 'latency' AND NOT {_BAD}),
total AS (
  SELECT scrape_id, any_value(namespace) AS namespace, any_value(pod) AS pod, any_value(user_id) AS user_id,
    max(value) FILTER (WHERE role = 'histogram_sum') AS s, coalesce(max(value) FILTER (WHERE role = 'histogram_count'), max(value) FILTER (WHERE role = 'histogram_bucket'), 0) AS n
  FROM ok GROUP BY scrape_id),
diff AS (SELECT scrape_id, bound, value - coalesce(lag(value) OVER (PARTITION BY scrape_id ORDER BY bound), 0) AS d FROM ok WHERE role = 'histogram_bucket'),
listed AS (SELECT scrape_id, string_agg(bound::DOUBLE::VARCHAR, ',' ORDER BY bound) FILTER (WHERE NOT isinf(bound)) AS bounds,
  string_agg(d::BIGINT::VARCHAR, ',' ORDER BY bound) FILTER (WHERE NOT isinf(bound)) AS counts, sum(d) FILTER (WHERE NOT isinf(bound)) AS used FROM diff GROUP BY scrape_id)
SELECT scrape_id, '{{namespace="' || namespace || '", node="' || user_id || '", pod="' || pod || '"}}' AS labels, bounds, counts || ',' || (n - used)::BIGINT AS bucket_counts, n::BIGINT AS count, s AS sum
FROM total JOIN listed USING (scrape_id)
"""


def summary_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = view(spark, sf_dir, "v_samples").filter("name = 'latency_bucket'")
    q = F.when(F.col("le") == "5", "0.5").when(F.col("le") == "10", "0.9").when(F.col("le") == "20", "0.9").when(F.col("le") == "40", "2")
    table = attributes(base.withColumn("q", q).filter("q is not null").withColumn("role", F.lit("summary_quantile")), "labels", quantile="q", pod="pod").withColumn("ts_ms", F.lit(0).cast("long"))
    out = ops.assemble_summaries(table)
    return out.select("scrape_id", "labels", F.array_join(F.transform("quantiles", lambda x: F.concat_ws("=", x["q"].cast("string"), x["v"].cast("long").cast("string"))), ",").alias("quantiles"), "count")


SQL["summary_assembly"] = """
WITH x AS (SELECT scrape_id, pod, value::BIGINT AS v, CASE pos WHEN 10 THEN 0.5 WHEN 12 THEN 0.9 END AS q FROM v_samples WHERE name = 'latency_bucket' AND pos IN (10, 12)),
y AS (SELECT scrape_id, pod, value::BIGINT AS v, 0.9 AS q FROM v_samples WHERE false)
SELECT scrape_id, '{pod="' || any_value(pod) || '"}' AS labels, string_agg(q::DOUBLE::VARCHAR || '=' || v, ',' ORDER BY q) AS quantiles, 0::BIGINT AS count FROM x GROUP BY scrape_id
"""


def number_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = _samples(spark, sf_dir).withColumn("name", F.when(F.col("user_id") % 7 == 0, F.replace("name", F.lit("temperature"), F.lit("requests_total"))).otherwise(F.col("name")))
    return ops.number_points(renamed).groupBy("name", "type", "collision", "is_monotonic").agg(F.count("*").alias("n"))


SQL["number_points"] = """
SELECT CASE WHEN user_id % 7 = 0 THEN 'requests_total' ELSE name END AS name, CASE role WHEN 'counter' THEN 'sum' ELSE 'gauge' END AS type,
  user_id % 7 = 0 AND role = 'gauge' AS collision, role = 'counter' AS is_monotonic, count(*) AS n FROM v_samples WHERE role IN ('counter', 'gauge') GROUP BY ALL
"""


def split_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.split_by_object(_samples(spark, sf_dir), [Splitter("temp.*", (("namespace", "k8s.namespace.name"), ("pod", "k8s.pod.name"), ("node", "k8s.node.name")), "le")])
    at = lambda m, k: F.coalesce(F.col(m)[k], F.lit(""))
    return out.groupBy("family", at("resource", "k8s.pod.name").alias("pod"), at("labels", "k8s.node.name").alias("node"), F.size("labels").alias("left")).agg(F.count("*").alias("n"))


SQL["split_by_object"] = """
SELECT family, CASE family WHEN 'temperature' THEN pod ELSE '' END AS pod, CASE family WHEN 'temperature' THEN user_id::VARCHAR ELSE '' END AS node,
  CASE WHEN family = 'temperature' THEN 1 WHEN le IS NULL THEN 3 ELSE 4 END AS left, count(*) AS n FROM v_samples GROUP BY ALL
"""


def rollups_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = view(spark, sf_dir, "v_samples").withColumn("name", F.concat(F.lit("container_"), F.when(F.col("pos") == 0, "network_").otherwise(""), F.col("name")))
    base = base.withColumns({"pod_l": F.when(F.col("user_id") % 3 > 0, F.col("pod")), "container_l": F.when(F.col("user_id") % 3 == 2, F.lit("main"))})
    return ops.drop_rollups(attributes(base, "labels", pod="pod_l", container="container_l")).groupBy("name").agg(F.count("*").alias("n"))


SQL["rollups_dropped"] = """
SELECT 'container_' || CASE WHEN pos = 0 THEN 'network_' ELSE '' END || name AS name, count(*) AS n FROM v_samples
WHERE user_id % 3 = 2 OR (user_id % 3 = 1 AND pos = 0) GROUP BY ALL
"""


def _scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = view(spark, sf_dir, "v_samples").groupBy("user_id", "hour").agg(F.count("*").alias("samples"))
    return base.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), F.col("hour").alias("scraped"), (F.col("hour") % 5 != 0).alias("ok"), (F.col("samples") / 4.0).alias("seconds"), "samples")


_SCRAPES = "scrapes AS (SELECT 't' || user_id AS target, hour AS scraped, hour % 5 <> 0 AS ok, count(*) / 4.0::DOUBLE AS seconds, count(*) AS samples FROM v_samples GROUP BY user_id, hour)"


def scrape_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scrape_health(_scrapes(spark, sf_dir)).groupBy("target", "name").agg(F.avg("value").alias("mean"))


SQL["scrape_health"] = f"""
WITH {_SCRAPES}
SELECT target, 'up' AS name, avg(ok::INTEGER) AS mean FROM scrapes GROUP BY ALL UNION ALL SELECT target, 'scrape_duration_seconds', avg(seconds) FROM scrapes GROUP BY ALL
UNION ALL SELECT target, 'scrape_samples_scraped', avg(samples) FROM scrapes GROUP BY ALL
"""


def target_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = view(spark, sf_dir, "v_pods").select(F.concat(F.lit("t"), F.col("pod_no").cast("string")).alias("target"))
    return ops.target_status(targets, _scrapes(spark, sf_dir)).select("target", "state", F.coalesce("scraped", F.lit(-1).cast("long")).alias("scraped"))


SQL["target_status"] = f"""
WITH {_SCRAPES}
SELECT 't' || pod_no AS target, CASE WHEN l.ok IS NULL THEN 'pending' WHEN l.ok THEN 'up' ELSE 'down' END AS state, coalesce(l.scraped, -1) AS scraped
FROM v_pods LEFT JOIN (SELECT target, arg_max(ok, scraped) AS ok, max(scraped) AS scraped FROM scrapes GROUP BY target) l ON l.target = 't' || pod_no
"""


def cap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cap_samples(_samples(spark, sf_dir), 6).groupBy("name", "failed").agg(F.count("*").alias("n"))


SQL["cap_samples"] = """
WITH x AS (SELECT name, row_number() OVER (PARTITION BY scrape_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY scrape_id) > 6 AS failed FROM v_samples)
SELECT name, failed, count(*) AS n FROM x WHERE r <= 6 GROUP BY ALL
"""


def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = view(spark, sf_dir, "v_readings")
    ordered = table.withColumn("at", F.struct("ts_us", "event_id"))
    return ops.counter_delta(ordered, ["user_id"], "at", "usage_usec").select("event_id", F.coalesce("delta", F.lit(-1).cast("long")).alias("delta"))


SQL["counter_delta"] = """
WITH x AS (SELECT event_id, usage_usec AS v, lag(usage_usec) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS b FROM v_readings)
SELECT event_id, coalesce(CASE WHEN v >= b THEN v - b WHEN b IS NOT NULL THEN v END, -1)::BIGINT AS delta FROM x
"""


def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written from the samples and parsed again."""
    line = F.concat("name", F.lit("{"), F.concat_ws(",", F.when(F.col("le").isNotNull(), F.concat(F.lit('le="'), F.col("le"), F.lit('"'))), F.concat(F.lit('pod="a\\\\\\"'), F.col("pod"), F.lit('"'))), F.lit("} "), F.col("value").cast("long").cast("string"), F.lit(" "), F.col("scrape_ms").cast("string"))
    rows = view(spark, sf_dir, "v_samples").groupBy("user_id", "hour", "scrape_id").agg(F.concat_ws("\n", F.lit("# TYPE requests_total counter\n# TYPE temperature gauge\n# HELP latency Some help.\n# TYPE latency histogram"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("not a series")).alias("body"))
    out = ops.parse_exposition(rows)
    return out.groupBy("name", "family", "role", F.coalesce(F.col("labels")["le"], F.lit("")).alias("le"), "malformed").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.coalesce(F.min(F.col("labels")["pod"]), F.lit("")).alias("least_pod"))


SQL["exposition"] = """
SELECT name, CASE WHEN role = 'counter' THEN name ELSE family END AS family, role, coalesce(le, '') AS le, false AS malformed, count(*) AS n, sum(trunc(value))::DOUBLE AS total, 'a' || chr(92) || '"' || min(pod) AS least_pod
FROM v_samples GROUP BY ALL
UNION ALL SELECT 'not a series', 'not a series', 'gauge', '', true, count(DISTINCT scrape_id), 0, '' FROM v_samples
"""


def native_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(F.struct((F.col("user_id") % 5 - 2).cast("int").alias("offset"), F.lit(2).alias("length")), F.struct((F.col("user_id") % 3).cast("int").alias("offset"), F.lit(1).alias("length")))
    rows = view(spark, sf_dir, "v_samples").filter("name = 'requests_total'").select("scrape_id", F.when(F.col("user_id") % 11 == 0, -53).otherwise(3).alias("schema"), spans.alias("spans"), F.array(F.col("value").cast("long"), F.lit(2).cast("long"), F.lit(-1).cast("long")).alias("deltas"), F.lit(1).cast("long").alias("count"))
    out = ops.native_to_exponential(rows)
    return out.select("scrape_id", F.coalesce("scale", F.lit(-99)).alias("scale"), F.coalesce("offset", F.lit(-99)).alias("first"), F.coalesce(F.array_join(F.col("counts").cast(_ARRAY), ","), F.lit("")).alias("counts"), "count")


SQL["native_histograms"] = """
WITH x AS (SELECT scrape_id, user_id, value::BIGINT AS v, user_id % 11 = 0 AS bad FROM v_samples WHERE name = 'requests_total')
SELECT scrape_id, CASE WHEN bad THEN -99 ELSE 3 END AS scale, CASE WHEN bad THEN -99 ELSE user_id % 5 - 3 END::INTEGER AS first,
  CASE WHEN bad THEN '' ELSE v || ',' || (v + 2) || ',' || repeat('0,', (user_id % 3)::INTEGER) || (v + 1) END AS counts, 3 * v + 3 AS count FROM x
"""

_WINDOW = 6 * 3_600_000_000


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_distribution(view(spark, sf_dir, "v_readings"), _WINDOW, "user_id")


_USED = f"""rate AS (
  SELECT *, usage_usec - lag(usage_usec) OVER w AS used, ts_us - lag(ts_us) OVER w AS passed FROM v_readings WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, usage_usec)),
usage AS (
  SELECT user_id, ts_us // {_WINDOW} AS "window", count(cores) AS cpu_samples, avg(cores) AS cpu_mean, stddev_pop(cores) AS cpu_stddev, min(cores) AS cpu_min, max(cores) AS cpu_max,
    count(*) AS memory_samples, avg(ws) AS memory_mean, stddev_pop(ws) AS memory_stddev, min(ws) AS memory_min, max(ws) AS memory_max
  FROM (SELECT *, CASE WHEN used >= 0 AND passed > 0 THEN used::DOUBLE / passed END AS cores, greatest(memory_bytes - inactive_bytes, 0)::DOUBLE AS ws FROM rate)
  GROUP BY ALL HAVING count(cores) >= 2)"""


def usage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _usage(spark, sf_dir)
    return out.select("user_id", "window", "cpu_samples", "memory_samples", *(F.round(c, 6).alias(c) for c in ("cpu_mean", "cpu_stddev", "cpu_min", "cpu_max")), *(F.round(c, 2).alias(c) for c in ("memory_mean", "memory_min", "memory_max")))


SQL["usage_distribution"] = f"""
WITH {_USED}
SELECT user_id, "window", cpu_samples, memory_samples, round(cpu_mean, 6) AS cpu_mean, round(cpu_stddev, 6) AS cpu_stddev, round(cpu_min, 6) AS cpu_min, round(cpu_max, 6) AS cpu_max,
  round(memory_mean, 2) AS memory_mean, round(memory_min, 2) AS memory_min, round(memory_max, 2) AS memory_max FROM usage
"""


def usage_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.hold(_usage(spark, sf_dir), "user_id", ["cpu_samples", "memory_max"])


SQL["usage_held"] = f"""
WITH {_USED},
spine AS (SELECT user_id, unnest(range(min("window"), max("window") + 1)) AS w FROM usage GROUP BY user_id),
held AS (SELECT spine.user_id, w, last_value(cpu_samples IGNORE NULLS) OVER x AS cpu_samples, last_value(memory_max IGNORE NULLS) OVER x AS memory_max
  FROM spine LEFT JOIN usage ON spine.user_id = usage.user_id AND w = "window" WINDOW x AS (PARTITION BY spine.user_id ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT user_id, w AS "window", cpu_samples, memory_max FROM held WHERE cpu_samples IS NOT NULL
"""
QUERIES = {name: globals()[name] for name in SQL}
