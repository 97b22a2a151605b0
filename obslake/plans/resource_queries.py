"""Queries over resources, empty metrics, hooked targets and the trace chain, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resources, sampling
from ..operators.resources import ResourceConfig
from ..operators.trace_chain import TraceChain, run_trace_chain
from .cluster_queries import _EVERY_TARGET, _targets
from .views import span_table, view

SQL: dict[str, str] = {}

_CONFIG = ResourceConfig(static={"cluster": "c1", "service.name": "unset"}, templates={"service.name": "app", "zone": "nullif(split(node, '-')[1], '7')"}, instance_prefix="c1/", disable=(r"k8s\.pod\.uid", "container.*"))


def built_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pods = view(spark, sf_dir, "v_pods").select("pod_no", F.col("name").alias("pod"), "namespace", "node", F.col("uid").alias("pod_uid"), F.when(F.col("pod_no") % 3 == 0, F.col("container_id")).alias("container_id"), "app")
    out = resources.build_resource(pods, _CONFIG)
    at = lambda k: F.coalesce(F.col("resource")[k], F.lit(""))
    return out.select("pod_no", F.size("resource").alias("n"), at("service.name").alias("service"), at("zone").alias("zone"), at("service.namespace").alias("namespace"), at("service.instance.id").alias("instance"))


SQL["built_resources"] = """
WITH x AS (SELECT pod_no, app, namespace, split_part(node, '-', 2) AS zone, CASE WHEN pod_no % 3 = 0 THEN container_id ELSE uid END AS id FROM v_pods)
SELECT pod_no, (7 + (zone <> '7')::INTEGER)::INTEGER AS n, app AS service, CASE WHEN zone = '7' THEN '' ELSE zone END AS zone, namespace, 'c1/' || id AS instance FROM x
"""


def empty_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes as pushed metrics; a family whose values are all below 2 has no points."""
    points = F.collect_list(F.when(F.col("value") >= 2, F.col("value")))
    families = view(spark, sf_dir, "v_samples").groupBy("scrape_id", "family").agg(points.alias("points"))
    pushed = families.groupBy("scrape_id").agg(F.collect_list(F.struct("family", "points")).alias("metrics"))
    return resources.drop_empty_metrics(pushed).select("scrape_id", "dropped", F.size("metrics").alias("kept"))


SQL["empty_metrics"] = """
WITH f AS (SELECT scrape_id, family, count(*) FILTER (WHERE value >= 2) AS n FROM v_samples GROUP BY ALL)
SELECT scrape_id, count(*) FILTER (WHERE n = 0)::INTEGER AS dropped, count(*) FILTER (WHERE n > 0)::INTEGER AS kept FROM f GROUP BY scrape_id HAVING count(*) FILTER (WHERE n > 0) > 0
"""


def hooked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs after the hook, of every target of every pod."""
    out = resources.hooked_targets(_targets(spark, sf_dir, None), ~F.col("url").contains("/custom"), F.when(F.col("url").contains("9100"), "federate"))
    return out.groupBy("url").agg(F.count("*").alias("n"))


SQL["hooked_targets"] = f"""
WITH {_EVERY_TARGET}
SELECT CASE WHEN contains(url, '9100') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/federate' ELSE url END AS url, count(*) AS n FROM one WHERE NOT contains(url, '/custom') GROUP BY 1
"""


def trace_chain_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = TraceChain([sampling.status_code("errors", ["ERROR"]), sampling.latency("slow", 3_000_000_000)], head_share=0.3)
    return run_trace_chain(span_table(spark, sf_dir), chain)["exported"].groupBy("service", "kind").agg(F.count("*").alias("spans"))


SQL["trace_chain_exports"] = f"""
WITH head AS (SELECT * FROM v_spans WHERE ('0x' || substr(md5(trace_id), 1, 15))::BIGINT < {sampling.threshold(0.3)} OR status = 'ERROR'),
trace AS (SELECT trace_id FROM head GROUP BY trace_id HAVING bool_or(status = 'ERROR') OR max(greatest(start_ns, end_ns)) FILTER (WHERE start_ns <> 0) - min(start_ns) FILTER (WHERE start_ns <> 0) >= 3000000000)
SELECT service, kind, count(*) AS spans FROM head JOIN trace USING (trace_id) GROUP BY ALL
"""
QUERIES = {name: globals()[name] for name in SQL}
