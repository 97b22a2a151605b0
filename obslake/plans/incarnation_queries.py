"""Queries of pods, names and containers over time, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incarnations as inc
from ..operators import kubernetes as k8s

SQL: dict[str, str] = {}


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod for each customer, three of which have a name in common; an event for each day with orders; a container that is another every 200 days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long")
    events = orders.groupBy(F.col("o_custkey").alias("uid"), day.alias("day")).agg((F.max(F.col("o_orderkey") % 4) == 0).alias("deleted"))
    container = F.struct(F.concat_ws("-", F.col("uid").cast("string"), F.floor(F.col("day") / 200).cast("string")).alias("id"), F.lit("app").alias("name"))
    return events.select("uid", "day", "deleted", F.lit("ns").alias("namespace"), F.concat(F.lit("pod-"), F.floor(F.col("uid") / 3).cast("string")).alias("name"), F.array(container).alias("containers"))


_FEED = """
e AS (SELECT o_custkey AS uid, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, max(o_orderkey % 4) = 0 AS deleted FROM orders GROUP BY ALL),
live AS (
  SELECT uid, day AS valid_from, 'pod-' || (uid // 3) AS name, uid || '-' || (day // 200) AS cid,
    (SELECT min(o.day) FROM e o WHERE o.uid = e.uid AND o.day > e.day) AS own,
    (SELECT min(o.day) FROM e o WHERE o.uid // 3 = e.uid // 3 AND o.uid <> e.uid AND NOT o.deleted AND (o.day, o.uid) > (e.day, e.uid)) AS taken
  FROM e WHERE NOT deleted),
pods AS (
  SELECT l.*, least(own, taken) AS valid_to, CASE WHEN taken <= own OR own IS NULL AND taken IS NOT NULL THEN 'replaced' WHEN n.deleted THEN 'deleted' WHEN own IS NOT NULL THEN 'updated' END AS ended_by
  FROM live l LEFT JOIN e n ON n.uid = l.uid AND n.day = l.own WHERE least(own, taken) IS NULL OR least(own, taken) > valid_from)"""


def pod_incarnations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of pods and why they ended."""
    return inc.pod_intervals(_feed(spark, sf_dir), "day").select("uid", "name", "valid_from", "valid_to", "ended_by")


SQL["pod_incarnations"] = f"WITH {_FEED} SELECT uid, name, valid_from, valid_to, ended_by FROM pods"


def name_incarnations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's pod by its name, ten days after the order: whoever has the name then, a deleted pod for thirty days."""
    names = inc.name_intervals(inc.pod_intervals(_feed(spark, sf_dir), "day"), 30).select("name", F.col("uid").alias("holder"), "valid_from", "valid_to")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    facts = orders.select("o_orderkey", F.concat(F.lit("pod-"), F.floor(F.col("o_custkey") / 3).cast("string")).alias("name"), (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") + 10).alias("at"))
    return k8s.as_of(facts, names, "name", "at").select("o_orderkey", "name", F.coalesce("holder", F.lit(-1).cast("long")).alias("holder"))


SQL["name_incarnations"] = f"""
WITH {_FEED},
fact AS (SELECT o_orderkey, 'pod-' || (o_custkey // 3) AS name, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 10 AS at_day FROM orders),
met AS (
  SELECT o_orderkey, fact.name, uid, valid_from FROM fact JOIN pods p ON p.name = fact.name AND at_day >= valid_from
    AND (valid_to IS NULL OR at_day < CASE WHEN ended_by = 'deleted' THEN least(valid_to + 30, coalesce(taken, valid_to + 30)) ELSE valid_to END))
SELECT fact.o_orderkey, fact.name, coalesce(arg_max(uid, valid_from), -1) AS holder FROM fact LEFT JOIN met USING (o_orderkey) GROUP BY ALL
"""


def container_incarnations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of containers and why they ended."""
    return inc.container_intervals(inc.pod_intervals(_feed(spark, sf_dir), "day")).select("container_id", "uid", "name", "valid_from", "valid_to", "ended_by")


SQL["container_incarnations"] = f"""
WITH {_FEED},
runs AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY cid ORDER BY valid_from) AS g
  FROM (SELECT *, coalesce(lag(valid_to) OVER (PARTITION BY cid ORDER BY valid_from) < valid_from, true) AS begins FROM pods))
SELECT cid AS container_id, uid, any_value(name) AS name, min(valid_from) AS valid_from, arg_max_null(valid_to, valid_from) AS valid_to,
  arg_max_null(CASE ended_by WHEN 'updated' THEN 'restarted' ELSE ended_by END, valid_from) AS ended_by
FROM runs GROUP BY cid, uid, g
"""

QUERIES = {name: globals()[name] for name in SQL}
