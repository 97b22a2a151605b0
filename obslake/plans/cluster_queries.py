"""Queries over the pod and service views, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import arm_id, cgroup_identity, file_identity, hex_id, instance_id, path_attributes, prom_duration_ms, service_name
from ..operators import kubernetes as k8s
from ..operators import targets as tg
from .views import attributes, log_table, view

SQL: dict[str, str] = {}


def _pods(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Pods; spread: dealt over all tasks first, for work that is much for a pod."""
    base = view(spark, sf_dir, "v_pods", "c_custkey" if spread else "")
    base = attributes(base, "annotations", **{tg.SCRAPE: "scrape_annotation", tg.PORT: "port_annotation", tg.PATH: "path_annotation"})
    ports = F.when(F.col("pod_no") % 4 == 0, F.array(F.struct(F.lit("metrics").alias("name"), F.lit(8080).alias("port")))).otherwise(F.array(F.struct(F.lit("http").alias("name"), F.lit(80).alias("port")), F.struct(F.lit("metrics").alias("name"), F.lit(9100).alias("port"))))
    return attributes(base.withColumn("ports", ports), "labels", app="app", node="node")


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = attributes(view(spark, sf_dir, "v_services"), "selector", app="selector_app", node="selector_node")
    return attributes(base, "annotations", **{tg.SCRAPE: "scrape_annotation"})


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long")
    return orders.groupBy(F.col("o_custkey").alias("pod_no"), day.alias("day")).agg(F.max("o_orderkey").alias("version"), (F.max(F.col("o_orderkey") % 4) == 0).alias("deleted"))


_CHANGES = "changes AS (SELECT o_custkey AS pod_no, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, max(o_orderkey) AS version, max(o_orderkey % 4) = 0 AS deleted FROM orders GROUP BY ALL)"
_INTERVALS = f"{_CHANGES}, intervals AS (SELECT * FROM (SELECT *, day AS valid_from, lead(day) OVER (PARTITION BY pod_no ORDER BY day) AS valid_to FROM changes) WHERE NOT deleted)"


def pod_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k8s.validity(_changes(spark, sf_dir), ["pod_no"], "day", "deleted")
    return out.select("pod_no", "version", "valid_from", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"))


SQL["pod_validity"] = f"WITH {_INTERVALS} SELECT pod_no, version, valid_from, coalesce(valid_to, -1) AS valid_to FROM intervals"


def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = k8s.validity(_changes(spark, sf_dir), ["pod_no"], "day", "deleted").select("pod_no", "version", "valid_from", "valid_to")
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("pod_no"), (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") + 20).alias("at"))
    return k8s.as_of(facts, intervals, "pod_no", "at", ttl=30).select("o_orderkey", "pod_no", F.coalesce("version", F.lit(-1).cast("long")).alias("version"))


SQL["as_of_lookup"] = f"""
WITH {_INTERVALS},
fact AS (SELECT o_orderkey, o_custkey AS pod_no, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 20 AS t FROM orders)
SELECT o_orderkey, fact.pod_no, coalesce(arg_max(version, valid_from), -1) AS version
FROM fact LEFT JOIN intervals i ON i.pod_no = fact.pod_no AND t >= valid_from AND (valid_to IS NULL OR t < valid_to + 30) GROUP BY ALL
"""


def pod_ip_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k8s.pod_ip_owners(_pods(spark, sf_dir))


_IPS = """ips AS (SELECT ip, uid FROM v_pods WHERE ip <> '' AND NOT host_network AND phase NOT IN ('Succeeded', 'Failed')
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY terminating, claim_seq DESC, uid DESC) = 1)"""
SQL["pod_ip_owners"] = f"WITH {_IPS} SELECT * FROM ips"


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = log_table(spark, sf_dir)
    return table.select(
        "log_id", F.when(F.col("log_id") % 3 == 0, F.concat(F.lit("containerd://"), F.col("container_id"))).alias("container_id"), F.when(F.col("log_id") % 3 == 1, F.col("namespace")).alias("namespace"),
        "pod", F.concat(F.lit("10.0.0."), (F.col("log_id") % 9).cast("string")).alias("peer_ip"), "resource",
    )


def pod_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k8s.attribute_to_pods(_telemetry(spark, sf_dir), _pods(spark, sf_dir)).select("log_id", F.coalesce("pod_uid", F.lit("")).alias("pod_uid"), "found_by")


SQL["pod_attribution"] = f"""
WITH {_IPS},
t AS (SELECT log_id, CASE WHEN log_id % 3 = 0 THEN container_id END AS cid, CASE WHEN log_id % 3 = 1 THEN namespace END AS ns, pod, '10.0.0.' || (log_id % 9) AS peer FROM v_logs)
SELECT log_id, coalesce(c.uid, n.uid, i.uid, '') AS pod_uid, CASE WHEN c.uid IS NOT NULL THEN 'container' WHEN n.uid IS NOT NULL THEN 'name' WHEN i.uid IS NOT NULL THEN 'ip' ELSE 'none' END AS found_by
FROM t LEFT JOIN v_pods c ON c.container_id = cid LEFT JOIN v_pods n ON n.namespace = ns AND n.name = t.pod LEFT JOIN ips i ON i.ip = peer
"""


def resource_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _telemetry(spark, sf_dir).withColumn("resolved", F.create_map(F.lit("k8s.pod.name"), F.concat(F.lit("real-"), F.col("pod")), F.lit("app"), F.lit("found")))
    rows = rows.withColumn("resource", F.when(F.col("log_id") % 2 == 0, F.map_concat("resource", F.create_map(F.lit("app"), F.lit("sent")))).otherwise(F.col("resource")))
    out = k8s.merge_resolved(rows)
    return out.select("log_id", F.col("resource")["k8s.pod.name"].alias("pod"), F.col("resource")["app"].alias("app"), F.size("resource").alias("n"))


SQL["resource_merge"] = "SELECT log_id, 'real-' || pod AS pod, CASE WHEN log_id % 2 = 0 THEN 'sent' ELSE 'found' END AS app, 4 AS n FROM v_logs"


def point_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _pods(spark, sf_dir).filter("pod_no % 2 = 0").select(F.col("container_id").alias("id"), F.create_map(F.lit("container.id"), F.col("container_id"), F.lit("k8s.pod.name"), F.concat(F.lit("known-"), F.col("name"))).alias("attrs"))
    rows = log_table(spark, sf_dir).withColumn("labels", F.when(F.col("log_id") % 4 == 0, F.create_map(F.lit("container.id"), F.concat(F.md5((F.col("user_id") + 1).cast("string")), F.md5((F.col("user_id") + 1).cast("string"))))).when(F.col("log_id") % 4 == 1, F.create_map(F.lit("container.id"), F.col("container_id"))).otherwise(F.create_map().cast("map<string,string>")))
    out = k8s.attribute_points(rows, known, "container.id")
    return out.groupBy("foreign", F.coalesce(F.col("resource")["k8s.pod.name"], F.lit("")).alias("pod"), F.size("resource").alias("n_attrs")).agg(F.count("*").alias("n"))


SQL["point_attribution"] = """
WITH x AS (SELECT *, CASE log_id % 4 WHEN 0 THEN user_id + 1 WHEN 1 THEN user_id END AS who FROM v_logs),
y AS (SELECT x.*, who % 2 = 0 AND who IN (SELECT c_custkey FROM customer) AS known FROM x)
SELECT log_id % 4 = 0 AS foreign, CASE WHEN known THEN 'known-pod-' || who WHEN log_id % 4 = 0 THEN '' ELSE pod END AS pod,
  CASE WHEN log_id % 4 = 0 AND known THEN 2 WHEN log_id % 4 = 0 THEN 1 ELSE 3 END AS n_attrs, count(*) AS n FROM y GROUP BY ALL
"""


def owner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda kind, name, uid: F.struct(F.lit(kind).alias("kind"), name.alias("name"), uid.alias("uid"))
    pods = _pods(spark, sf_dir).withColumn("owner_refs", F.array(ref("ReplicaSet", F.col("owner_name"), F.col("owner_uid"))))
    sets = pods.groupBy(F.col("owner_name").alias("name"), F.col("owner_uid").alias("uid")).agg(F.first(F.lit("ReplicaSet")).alias("kind")).filter("name <> 'rs-3'")
    number = F.substring("name", 4, 9).cast("int") % 6
    sets = sets.withColumn("owner_refs", F.array(ref("Deployment", F.concat(F.lit("deploy-"), number.cast("string")), F.md5(number.cast("string")))))
    out = k8s.owner_chain(pods, sets).join(pods.select("uid", "pod_no"), "uid")
    kinds = F.transform("owners", lambda o: F.struct(F.split(o, "/")[0].alias("kind"), F.split(o, "/")[1].alias("name")))
    return out.select("pod_no", F.array_join("owners", " ").alias("owners"), service_name(kinds, F.concat(F.lit("pod-"), F.col("pod_no").cast("string"))).alias("service_name"))


SQL["owner_chain"] = """
SELECT pod_no, 'ReplicaSet/' || owner_name || CASE WHEN pod_no % 25 <> 3 THEN ' Deployment/deploy-' || ((pod_no % 25) % 6) ELSE '' END AS owners,
  CASE WHEN pod_no % 25 <> 3 THEN 'deploy-' || ((pod_no % 25) % 6) ELSE name END AS service_name FROM v_pods
"""

_SELECTED = """selected AS (
  SELECT s.uid AS service_uid, p.uid AS pod_uid, s.name AS service, s.target_port, s.scrape_annotation AS svc_scrape FROM v_services s JOIN v_pods p ON s.namespace = p.namespace
    AND coalesce(s.selector_app = p.app, true) AND coalesce(s.selector_node = p.node, true) WHERE s.selector_app IS NOT NULL OR s.selector_node IS NOT NULL)"""


def service_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k8s.select_pods(_services(spark, sf_dir), _pods(spark, sf_dir, spread=True))


SQL["service_selection"] = f"WITH {_SELECTED} SELECT service_uid, pod_uid FROM selected"

_MONITORS = [
    {"name": "apps", "match_labels": {"app": "building"}, "namespaces": None},
    {"name": "some", "expressions": [("app", "In", ["machinery", "household"]), ("node", "NotIn", ["node-1", "node-2"])], "namespaces": ["team-1", "team-2"]},
    {"name": "all", "expressions": [("app", "Exists", []), ("canary", "DoesNotExist", [])], "namespaces": ["team-3"]},
]
_MONITORED = """monitored AS (
  SELECT uid, 'apps' AS monitor FROM v_pods WHERE app = 'building'
  UNION ALL SELECT uid, 'some' FROM v_pods WHERE app IN ('machinery', 'household') AND node NOT IN ('node-1', 'node-2') AND namespace IN ('team-1', 'team-2')
  UNION ALL SELECT uid, 'all' FROM v_pods WHERE namespace = 'team-3')"""


def monitor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k8s.monitored(_pods(spark, sf_dir), _MONITORS)


SQL["monitor_selection"] = f"WITH {_MONITORED} SELECT * FROM monitored"


def opted_in_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = _services(spark, sf_dir)
    seen = services.filter("service_no % 5 = 0").select(F.col("uid").alias("service_uid"))
    return k8s.opted_in(services, seen).select("uid", "name")


SQL["opted_in_services"] = "SELECT uid, name FROM v_services WHERE scrape_annotation = 'true' OR service_no % 5 = 0"


def namespace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = _pods(spark, sf_dir).select(F.col("namespace").alias("name")).distinct().filter("name <> 'team-2'").withColumn("labels", F.create_map(F.lit("tier"), F.concat(F.lit("t-"), F.col("name"))))
    out = k8s.namespace_labels(log_table(spark, sf_dir), spaces)
    return out.groupBy(F.coalesce(F.col("resource")["k8s.namespace.label.tier"], F.lit("")).alias("tier")).agg(F.count("*").alias("n"))


SQL["namespace_metadata"] = "SELECT CASE WHEN namespace = 'team-2' THEN '' ELSE 't-' || namespace END AS tier, count(*) AS n FROM v_logs GROUP BY ALL"

# --- targets

_OK = "ip <> '' AND NOT terminating AND phase NOT IN ('Succeeded', 'Failed')"
_PORTS = "CASE WHEN pod_no % 4 = 0 THEN [8080] ELSE [80, 9100] END"
_METRICS = "CASE WHEN pod_no % 4 = 0 THEN 8080 ELSE 9100 END"
_POD_TARGETS = f"""pod_ports AS (
  SELECT DISTINCT uid AS pod_uid, ip, path_annotation AS path, unnest(CASE WHEN pod_no % 5 = 0 THEN [8080, {_METRICS}] WHEN pod_no % 5 = 1 THEN [{_METRICS}] WHEN pod_no % 5 = 2 THEN [9090] ELSE {_PORTS} END) AS port
  FROM v_pods WHERE {_OK} AND scrape_annotation = 'true'),
pod_targets AS (SELECT pod_uid, 'http://' || ip || ':' || port || CASE WHEN path = 'stats' THEN '/stats' ELSE coalesce(path, '/metrics') END AS url, 'pod' AS source, NULL::VARCHAR AS service FROM pod_ports)"""
_SERVICE_TARGETS = f"""{_SELECTED},
service_targets AS (
  SELECT pod_uid, 'http://' || ip || ':' || CASE WHEN target_port = '8080' THEN 8080 ELSE {_METRICS} END || '/metrics' AS url, 'service' AS source, service
  FROM selected JOIN v_pods ON pod_uid = uid WHERE svc_scrape = 'true' AND {_OK})"""
_MONITOR_TARGETS = f"""{_MONITORED},
monitor_targets AS (
  SELECT p.uid AS pod_uid, 'http' || CASE monitor WHEN 'some' THEN 's' ELSE '' END || '://' || ip || ':' || CASE monitor WHEN 'all' THEN 9100 ELSE {_METRICS} END || '/metrics' AS url, 'monitor' AS source, NULL::VARCHAR AS service, monitor
  FROM monitored JOIN v_pods p USING (uid) WHERE {_OK})"""


def pod_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.reasons(_pods(spark, sf_dir)).groupBy(F.array_join("reasons", ", ").alias("reasons")).agg(F.count("*").alias("n"))


SQL["pod_reasons"] = "SELECT concat_ws(', ', CASE WHEN ip = '' THEN 'no address' END, CASE WHEN terminating THEN 'terminating' END, CASE WHEN phase IN ('Succeeded', 'Failed') THEN 'phase ' || phase END) AS reasons, count(*) AS n FROM v_pods GROUP BY ALL"


def pod_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.pod_targets(_pods(spark, sf_dir)).select("pod_uid", "url", "source")


SQL["pod_targets"] = f"WITH {_POD_TARGETS} SELECT pod_uid, url, source FROM pod_targets"


def service_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.all_service_targets(k8s.opted_in(_services(spark, sf_dir)), _pods(spark, sf_dir))


SQL["service_targets"] = f"WITH {_SERVICE_TARGETS} SELECT * FROM service_targets"


def _monitor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pods = _pods(spark, sf_dir)
    rows = F.array(*(F.struct(F.lit(m).alias("monitor"), F.lit(p).alias("port"), F.lit("").alias("path"), F.lit(s).alias("scheme")) for m, p, s in (("apps", "metrics", "http"), ("some", "metrics", "https"), ("all", "9100", "http"))))
    return tg.monitor_targets(k8s.monitored(pods, _MONITORS), spark.range(1).select(F.inline(rows)), pods)


def monitor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monitor_targets(spark, sf_dir).drop("service")


SQL["monitor_targets"] = f"WITH {_MONITOR_TARGETS} SELECT pod_uid, url, source, monitor FROM monitor_targets"

_EVERY_TARGET = f"""{_POD_TARGETS}, {_SERVICE_TARGETS}, {_MONITOR_TARGETS},
offered AS (SELECT pod_uid, url, source, service FROM pod_targets UNION ALL SELECT * FROM service_targets UNION ALL SELECT pod_uid, url, source, service FROM monitor_targets),
one AS (SELECT pod_uid, url, arg_min(source, CASE source WHEN 'monitor' THEN 0 WHEN 'pod' THEN 1 ELSE 2 END) AS source, min(service) AS service FROM offered GROUP BY ALL)"""
_ALL_TARGETS = f"""{_EVERY_TARGET},
deduped AS (SELECT *, row_number() OVER (PARTITION BY pod_uid ORDER BY url) AS r, greatest(count(*) OVER (PARTITION BY pod_uid) - 2, 0) AS beyond FROM one),
targets AS (SELECT pod_uid, url, source, service, beyond FROM deduped WHERE r <= 2)"""


def _targets(spark: SparkSession, sf_dir: str, most: int | None = 2) -> DataFrame:
    pods, leads = _pods(spark, sf_dir), tg.leading(tg.alike(k8s.opted_in(_services(spark, sf_dir))))
    # of services with the same target only the first name counts, so those that lead are enough
    offered = tg.pod_targets(pods).unionByName(tg.service_targets(leads, pods, k8s.select_pods(leads, pods))).unionByName(_monitor_targets(spark, sf_dir).drop("monitor"))
    return tg.dedupe_targets(offered, most)


def scrape_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).withColumn("service", F.coalesce("service", F.lit("")))


SQL["scrape_targets"] = f"WITH {_ALL_TARGETS} SELECT * REPLACE (coalesce(service, '') AS service) FROM targets"


def target_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.explain(_pods(spark, sf_dir), _targets(spark, sf_dir)).groupBy("note").agg(F.count("*").alias("pods"), F.sum("n_targets").alias("targets"))


SQL["target_explanations"] = f"""
WITH {_ALL_TARGETS},
n AS (SELECT pod_uid, count(*) AS n FROM targets GROUP BY pod_uid),
said AS (SELECT concat_ws(', ', CASE WHEN ip = '' THEN 'no address' END, CASE WHEN terminating THEN 'terminating' END, CASE WHEN phase IN ('Succeeded', 'Failed') THEN 'phase ' || phase END) AS why, scrape_annotation, coalesce(n, 0) AS n FROM v_pods LEFT JOIN n ON uid = pod_uid)
SELECT CASE WHEN why <> '' THEN why WHEN n > 0 THEN 'scraped' WHEN coalesce(scrape_annotation, '') <> 'true' THEN 'not opted in' ELSE 'no port' END AS note, count(*) AS pods, sum(n)::BIGINT AS targets FROM said GROUP BY ALL
"""


def _monitor_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(m).alias("monitor"), F.lit(p).alias("port"), F.lit("").alias("path"), F.lit(s).alias("scheme")) for m, p, s in (("apps", "metrics", "http"), ("some", "metrics", "https"), ("all", "9100", "http"))))
    return spark.range(1).select(F.inline(rows))


def target_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every port entry, service and monitor of each pod."""
    pods, services = _pods(spark, sf_dir, spread=True), _services(spark, sf_dir)
    odd = F.when(F.col("pod_no") % 17 == 0, F.map_concat(F.map_filter("annotations", lambda k, v: k != tg.PORT), F.create_map(F.lit(tg.PORT), F.lit("70000, gone ,,http,8080")))).otherwise(F.col("annotations"))
    out = tg.explain_all_targets(pods.withColumn("annotations", odd), services, k8s.monitored(pods, _MONITORS), _monitor_table(spark), 2)
    return out.select("pod_uid", "source", "subject", "entry", F.coalesce("port", F.lit(-1)).alias("port"), F.coalesce("url", F.lit("")).alias("url"), "verdict")


SQL["target_verdicts"] = f"""
WITH {_SELECTED}, {_MONITORED},
p AS (SELECT *, concat_ws(', ', CASE WHEN ip = '' THEN 'no address' END, CASE WHEN terminating THEN 'terminating' END, CASE WHEN phase IN ('Succeeded', 'Failed') THEN 'phase ' || phase END) AS why FROM v_pods),
entries AS (
  SELECT uid AS pod_uid, 'pod' AS source, '' AS subject, 1 AS rank, i AS pos, CASE WHEN path_annotation = 'stats' THEN '/stats' ELSE coalesce(path_annotation, '/metrics') END AS path, 'http' AS scheme, l[i] AS entry,
    CASE l[i] WHEN 'metrics' THEN {_METRICS} WHEN 'http' THEN CASE WHEN pod_no % 4 <> 0 THEN 80 END WHEN 'gone' THEN NULL ELSE try_cast(l[i] AS INT) END AS port, coalesce(scrape_annotation, '') <> 'true' AS out_
  FROM (SELECT *, CASE WHEN coalesce(scrape_annotation, '') <> 'true' THEN [''] WHEN pod_no % 17 = 0 THEN ['70000', 'gone', 'http', '8080'] WHEN pod_no % 5 = 0 THEN ['8080', 'metrics'] WHEN pod_no % 5 = 1 THEN ['metrics']
      WHEN pod_no % 5 = 2 THEN ['9090'] ELSE [x::VARCHAR for x in {_PORTS}] END AS l FROM p), range(1, 5) r(i) WHERE i <= len(l)
  UNION ALL SELECT pod_uid, 'service', service, 2, 0, '/metrics', 'http', target_port, CASE WHEN svc_scrape = 'true' THEN CASE target_port WHEN '8080' THEN 8080 ELSE {_METRICS} END END, coalesce(svc_scrape, '') <> 'true'
  FROM selected JOIN p ON p.uid = pod_uid
  UNION ALL SELECT uid, 'monitor', monitor, 0, 0, '/metrics', CASE monitor WHEN 'some' THEN 'https' ELSE 'http' END, CASE monitor WHEN 'all' THEN '9100' ELSE 'metrics' END, CASE monitor WHEN 'all' THEN 9100 ELSE {_METRICS} END, false
  FROM monitored JOIN p USING (uid)),
said AS (
  SELECT e.*, CASE WHEN out_ THEN 'not opted in' WHEN port NOT BETWEEN 1 AND 65535 THEN 'not a port number' WHEN port IS NULL THEN 'no such port' END AS base, nullif(why, '') AS why,
    CASE WHEN port BETWEEN 1 AND 65535 AND NOT out_ THEN scheme || '://' || ip || ':' || port || path END AS url
  FROM entries e JOIN p ON p.uid = e.pod_uid),
firsts AS (SELECT *, base IS NULL AND why IS NULL AS candidate, row_number() OVER (PARTITION BY pod_uid, url, base IS NULL AND why IS NULL ORDER BY rank, subject, pos, entry) AS f FROM said),
nths AS (SELECT pod_uid, url, row_number() OVER (PARTITION BY pod_uid ORDER BY url) AS nth FROM firsts WHERE candidate AND f = 1)
SELECT pod_uid, source, subject, entry, coalesce(port, -1) AS port, coalesce(f.url, '') AS url,
  CASE WHEN NOT candidate THEN coalesce(base, why) WHEN f > 1 THEN 'the same target as another' WHEN nth > 2 THEN 'over the ceiling' ELSE 'target' END AS verdict
FROM firsts f LEFT JOIN nths USING (pod_uid, url)
"""


def merged_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monitor_targets(spark, sf_dir).withColumn("url", F.replace("url", F.lit("https:"), F.lit("http:")))
    interval = F.when(F.col("monitor") == "apps", 30_000).when(F.col("monitor") == "some", 15_000)
    rows = rows.withColumns({"interval_ms": interval, "timeout_ms": F.when(interval.isNotNull(), F.length("monitor") * 1000).otherwise(1), "rules": F.array(F.when(F.col("monitor") == "all", "keep-x").otherwise("drop-y")), "auth": F.when(F.col("monitor") == "apps", "token")})
    out = tg.merge_monitors(rows)
    return out.select("pod_uid", "url", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("interval_ms", "timeout_ms")), F.array_join("rules", ",").alias("rules"), F.coalesce("auth", F.lit("")).alias("auth"), F.array_join("monitors", ",").alias("monitors"))


SQL["merged_monitors"] = f"""
WITH {_MONITOR_TARGETS},
m AS (SELECT pod_uid, replace(url, 'https:', 'http:') AS url, monitor, CASE monitor WHEN 'apps' THEN 30000 WHEN 'some' THEN 15000 END AS i, CASE monitor WHEN 'all' THEN 'keep-x' ELSE 'drop-y' END AS rule FROM monitor_targets),
r AS (SELECT pod_uid, url, rule, min(monitor) AS lead_by FROM m GROUP BY ALL),
rules AS (SELECT pod_uid, url, string_agg(rule, ',' ORDER BY lead_by) AS rules FROM r GROUP BY ALL)
SELECT pod_uid, url, coalesce(min(i), -1)::INTEGER AS interval_ms, CASE WHEN min(i) IS NULL THEN -1 ELSE 4000 END::INTEGER AS timeout_ms, any_value(rules) AS rules,
  CASE WHEN bool_or(monitor = 'apps') THEN 'token' ELSE '' END AS auth, string_agg(monitor, ',' ORDER BY monitor) AS monitors
FROM m JOIN rules USING (pod_uid, url) GROUP BY pod_uid, url
"""


def target_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _targets(spark, sf_dir).join(_pods(spark, sf_dir).select(F.col("uid").alias("pod_uid"), "namespace", F.col("app").alias("app")), "pod_uid").withColumn("service", F.col("app"))
    return tg.identity_collisions(named).select("namespace", "service", "instance", "n")


SQL["target_collisions"] = f"""
WITH {_ALL_TARGETS}
SELECT namespace, app AS service, regexp_extract(url, '://([^/]+)', 1) AS instance, count(DISTINCT pod_uid) AS n FROM targets JOIN v_pods ON pod_uid = uid GROUP BY ALL HAVING count(DISTINCT pod_uid) > 1
"""


def target_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What appears and goes between two derivations."""
    now = _targets(spark, sf_dir).select("url").distinct()
    before = tg.pod_targets(_pods(spark, sf_dir)).select("url").distinct()
    return before.exceptAll(now).withColumn("change", F.lit("removed")).unionByName(now.exceptAll(before).withColumn("change", F.lit("added")))


SQL["target_changes"] = f"""
WITH {_ALL_TARGETS}
SELECT url, 'removed' AS change FROM (SELECT DISTINCT url FROM pod_targets EXCEPT SELECT url FROM targets) UNION ALL SELECT url, 'added' FROM (SELECT DISTINCT url FROM targets EXCEPT SELECT url FROM pod_targets)
"""

# --- identities

_UID = "concat(substr(md5(o::VARCHAR), 1, 8), '-', substr(md5(o::VARCHAR), 9, 4), '-', substr(md5(o::VARCHAR), 13, 4), '-', substr(md5(o::VARCHAR), 17, 4), '-', substr(md5(o::VARCHAR), 21, 12))"


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids read out of paths: cgroups of both drivers, log files, cloud resources; durations."""
    o = F.col("o_orderkey")
    h = F.md5(o.cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    uid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    path = F.when(o % 3 == 0, F.concat(F.lit("/kubepods/burstable/pod"), uid, F.lit("/"), h, h)).when(o % 3 == 1, F.concat(F.lit("/kubepods.slice/kubepods-pod"), F.replace(uid, F.lit("-"), F.lit("_")), F.lit(".slice/cri-containerd-"), h, h, F.lit(".scope"))).otherwise("/system.slice/sshd.service")
    arm = F.concat(F.lit("/SUBSCRIPTIONS/S-"), (o % 7).cast("string"), F.lit("/resourceGroups/RG"), (o % 5).cast("string"), F.lit("/providers/Microsoft.Compute/virtualMachines/VM"), (o % 11).cast("string"), F.when(o % 2 == 0, "/providers/Microsoft.Insights/rules/R").otherwise(""))
    file = F.concat(F.lit("/var/log/web-"), (o % 9).cast("string"), F.lit("_team_app-"), h, h, F.when(o % 4 == 0, ".txt").otherwise(".log"))
    spoken = F.concat((o % 3).cast("string"), F.lit("d"), (o % 24).cast("string"), F.lit("h"), F.when(o % 13 == 0, "x").otherwise("5ms"))
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", cgroup_identity(path).alias("c"), arm_id(arm).alias("a"), file_identity(file).alias("f"), path_attributes(file, [r"web-(?P<replica>\d)", r"_(?P<team>[a-z]+)_"]).alias("p"), prom_duration_ms(spoken).alias("ms"), hex_id(F.when(o % 5 == 0, F.lit("0" * 32)).otherwise(uid), 32).alias("hex"), uid.alias("uid"))
    none = F.lit("")
    return found.select(
        "o_orderkey", *(F.coalesce(c, none).alias(n) for c, n in (("c.pod_uid", "pod_uid"), ("c.container_id", "container_id"), ("a.subscription", "subscription"), ("a.group", "grp"), ("a.type", "kind"), ("a.name", "name"), ("f.pod", "file_pod"), ("hex", "hex"))),
        F.coalesce(F.col("p")["replica"], none).alias("replica"), F.coalesce(F.col("p")["team"], none).alias("team"), F.coalesce("ms", F.lit(-1).cast("long")).alias("ms"), "c.is_pod_container",
        instance_id(F.col("c.container_id"), F.col("c.pod_uid"), F.lit("main"), F.lit("ns"), F.lit("pod"), F.lit("node")).alias("instance"),
    )


SQL["identities"] = f"""
WITH x AS (SELECT o_orderkey AS o, md5(o_orderkey::VARCHAR) AS h FROM orders)
SELECT o AS o_orderkey, CASE WHEN o % 3 < 2 THEN {_UID} ELSE '' END AS pod_uid, CASE WHEN o % 3 < 2 THEN h || h ELSE '' END AS container_id, 's-' || (o % 7) AS subscription, 'rg' || (o % 5) AS grp,
  CASE WHEN o % 2 = 0 THEN 'microsoft.insights/rules' ELSE 'microsoft.compute/virtualmachines' END AS kind, CASE WHEN o % 2 = 0 THEN 'r' ELSE 'vm' || (o % 11) END AS name,
  CASE WHEN o % 4 = 0 THEN '' ELSE 'web-' || (o % 9) END AS file_pod, CASE WHEN o % 5 = 0 THEN '' ELSE h END AS hex, (o % 9)::VARCHAR AS replica, 'team' AS team,
  CASE WHEN o % 13 = 0 THEN -1 ELSE (o % 3) * 86400000 + (o % 24) * 3600000 + 5 END AS ms, o % 3 < 2 AS is_pod_container, CASE WHEN o % 3 < 2 THEN h || h ELSE 'ns/pod/main' END AS instance
FROM x
"""
QUERIES = {name: globals()[name] for name in SQL}
