"""Queries over the log view, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cut_utf8
from ..functions.selectors import Record, line_field, record_severity, resolve, resolve_number
from ..operators import log_metrics, logs
from ..operators.log_metrics import Metric
from ..operators.logs import Lift, Rule
from .views import log_table

SQL: dict[str, str] = {}


def _field(key: str, path: str | None = None) -> str:
    """A field of the body in DuckDB: JSON path or logfmt key."""
    own = path or key
    return (
        f"CASE WHEN starts_with(body, '{{') THEN json_extract_string(body, '$.{own}') "
        f"ELSE nullif(trim(regexp_extract(body, '(?:^|\\s){own.replace('.', chr(92) + '.')}=(\"[^\"]*\"|[^\\s\"]*)', 1), '\"'), '') END"
    )


_STATUS, _TOOK, _LEVEL = _field("status", "http.status"), _field("took_ms"), _field("level")
_STEPS = logs.redactions(["defaults", "email"])


def _scrubbed(steps: list[logs.Redaction], text: str = "body") -> str:
    for pattern, replacement in (f for s in steps for f in s.forms):
        quoted, by = (x.replace("'", "''") for x in (pattern, replacement.replace("$", "\\")))
        text = f"regexp_replace({text}, '{quoted}', '{by}', 'g')"
    return text


def log_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_table(spark, sf_dir).select("log_id", logs.scrub(F.col("body"), _STEPS).alias("body"))


SQL["log_scrub"] = f"SELECT log_id, {_scrubbed(_STEPS)} AS body FROM v_logs"


def log_scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return docs.select("doc_id", F.md5(logs.scrub(F.col("body"), _STEPS)).alias("scrubbed_md5"))


SQL["log_scrub_documents"] = f"SELECT doc_id, md5({_scrubbed(_STEPS, "coalesce(text, '')")}) AS scrubbed_md5 FROM documents"


def log_scrub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scrub_counts(log_table(spark, sf_dir), _STEPS)


SQL["log_scrub_counts"] = "WITH " + ", ".join(["s0 AS (SELECT body AS b0 FROM v_logs)"] + [f"s{k + 1} AS (SELECT b{k}, {_scrubbed([s], f'b{k}')} AS b{k + 1} FROM s{k})" for k, s in enumerate(_STEPS)])
SQL["log_scrub_counts"] += " " + " UNION ALL ".join(f"SELECT '{s.name}' AS name, count(*) FILTER (WHERE b{k} <> b{k + 1}) AS n FROM s{k + 1}" for k, s in enumerate(_STEPS))


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    none = F.lit("")
    return log_table(spark, sf_dir).select("log_id", *(F.coalesce(F.when(body.startswith("{"), line_field(body, j)).otherwise(F.nullif(line_field(body, t), none)), none).alias(n) for n, j, t in (("status", "http.status", "http.status"), ("took_ms", "took_ms", "took_ms"), ("msg", "msg", "msg"))))


SQL["log_fields"] = f"SELECT log_id, coalesce({_STATUS}, '') AS status, coalesce({_TOOK}, '') AS took_ms, coalesce({_field('msg')}, '') AS msg FROM v_logs"


def log_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.lift_attributes(log_table(spark, sf_dir), [Lift("took_ms", "took"), Lift("user", "enduser.id", "resource"), Lift("level", "lvl", "scope")])
    at = lambda m, k: F.coalesce(F.col(m)[k], F.lit("")).alias(k.replace(".", "_"))
    return out.select("log_id", at("attrs", "took"), at("resource", "enduser.id"), at("scope_attrs", "lvl"), at("attrs", "event.type"))


SQL["log_lift"] = f"SELECT log_id, coalesce({_TOOK}, '') AS took, coalesce({_field('user')}, '') AS enduser_id, coalesce({_LEVEL}, '') AS lvl, event_type FROM v_logs"


def log_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = record_severity(F.col("severity_text"), F.col("severity_number")).alias("severity")
    return log_table(spark, sf_dir).groupBy("namespace", severity).agg(F.count("*").alias("n"))


_SEVERITY = "CASE WHEN coalesce(severity_text, '') <> '' THEN lower(severity_text) WHEN severity_number BETWEEN 5 AND 8 THEN 'debug' WHEN severity_number BETWEEN 9 AND 12 THEN 'info' WHEN severity_number BETWEEN 17 AND 20 THEN 'error' ELSE '' END"
SQL["log_severity"] = f"SELECT namespace, {_SEVERITY} AS severity, count(*) AS n FROM v_logs GROUP BY ALL"


def log_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.enrich_lines(log_table(spark, sf_dir))
    return out.select("log_id", "format", "severity_text", "severity_number", F.coalesce("trace_id", F.lit("")).alias("trace_id")).withColumns({"severity_text": F.coalesce("severity_text", F.lit(""))})


_FORMAT = "CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' ELSE 'none' END".replace("event_id", "log_id")
SQL["log_enrich"] = f"""
SELECT log_id, {_FORMAT} AS format, coalesce(severity_text, lower({_LEVEL}), '') AS severity_text,
  CASE WHEN severity_text IS NULL AND {_LEVEL} IS NOT NULL THEN CASE lower({_LEVEL}) WHEN 'debug' THEN 5 WHEN 'error' THEN 17 ELSE 9 END ELSE severity_number END::INTEGER AS severity_number,
  coalesce({_field('trace_id')}, '') AS trace_id
FROM v_logs
"""


def log_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_table(spark, sf_dir).groupBy(logs.enriched_format(F.col("body")).alias("format")).agg(F.count("*").alias("n"))


SQL["log_formats"] = f"SELECT {_FORMAT} AS format, count(*) AS n FROM v_logs GROUP BY ALL"


def log_timestamp_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, zoned = F.col("ts_us") - 1000, F.col("log_id") % 3 == 0
    own = F.when(F.col("log_id") % 2 == 0, F.col("ts_us"))
    return log_table(spark, sf_dir).select("log_id", logs.may_replace_timestamp(parsed, zoned, own).alias("ts_us"))


SQL["log_timestamp_rule"] = "SELECT log_id, CASE WHEN log_id % 3 = 0 OR log_id % 2 <> 0 THEN ts_us - 1000 ELSE ts_us END AS ts_us FROM v_logs"

_RULES = [
    Rule("drop", exact=("__severity__=debug", "k8s.namespace.name!=team-1")),
    Rule("keep", regex=("http.status=^[45]",)),
    Rule("drop", regex=("__line__=password",), exact=("k8s.namespace.name=team-2",)),
    Rule("keep", exact=("event.type=click",), share=0.25),
]
_HTTP = "CASE WHEN starts_with(body, '{') THEN json_extract_string(body, '$.http.status') END"
_RULE = f"""CASE WHEN {_SEVERITY} = 'debug' AND namespace <> 'team-1' THEN 0
  WHEN regexp_matches(coalesce({_HTTP}, ''), '^[45]') THEN 1
  WHEN contains(body, 'password') AND namespace = 'team-2' THEN 2 WHEN event_type = 'click' THEN 3 ELSE -1 END"""


def log_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.coalesce(logs.rule_index(_RULES), F.lit(-1)).alias("rule")
    return log_table(spark, sf_dir).groupBy(index).agg(F.count("*").alias("n"), F.sum("log_id").alias("ids"))


SQL["log_selectors"] = f"SELECT {_RULE} AS rule, count(*) AS n, sum(log_id)::BIGINT AS ids FROM v_logs GROUP BY ALL"


def log_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.line_rules(log_table(spark, sf_dir), _RULES, ["ts_us", "log_id"], ["pod"]).select("log_id", "pod")


SQL["log_line_rules"] = f"""
WITH hit AS (SELECT log_id, pod, ts_us, {_RULE} AS rule FROM v_logs),
nth AS (SELECT *, row_number() OVER (PARTITION BY rule, pod ORDER BY ts_us, log_id) - 1 AS n FROM hit)
SELECT log_id, pod FROM nth WHERE rule IN (-1, 1) OR (rule = 3 AND n % 4 = 0)
"""


def log_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = Record.default()
    table = log_table(spark, sf_dir)
    return table.select("log_id", resolve(record, "level").alias("level"), resolve(record, "event.type").alias("event_type"), F.coalesce(resolve_number(record, "took_ms"), F.lit(-1.0)).alias("took"))


SQL["log_resolution"] = f"SELECT log_id, coalesce({_LEVEL}, '') AS level, event_type, coalesce(try_cast({_TOOK} AS DOUBLE), -1) AS took FROM v_logs"


def log_workload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = log_table(spark, sf_dir)
    config = (
        F.when(F.col("user_id") % 5 == 0, '{"exclude":true}')
        .when(F.col("user_id") % 5 == 1, '{"serviceName":"checkout","rules":[{"action":"keep","match":"error"},{"action":"drop","regex":"took[_ ]"}]}')
        .when(F.col("user_id") % 5 == 2, "not json")
    )
    pods = table.select("namespace", "pod", config.alias("config")).distinct()
    return logs.workload_rules(table, pods).select("log_id", F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service_name"))


SQL["log_workload_rules"] = """
SELECT log_id, CASE WHEN user_id % 5 = 1 THEN 'checkout' ELSE '' END AS service_name FROM v_logs
WHERE user_id % 5 <> 0 AND NOT (user_id % 5 = 1 AND NOT contains(body, 'error') AND regexp_matches(body, 'took[_ ]'))
"""


def log_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = log_table(spark, sf_dir).withColumn("marker", F.when(F.col("event_type") == "purchase", "billing").when(F.col("log_id") % 50 == 0, "nowhere"))
    out = logs.route(marked, [("billing", ["pay-*"]), ("first", ["team-0", "team-1"]), ("rest", ["team-?"])], marker="marker")
    return out.groupBy("route", "namespace").agg(F.count("*").alias("n"))


SQL["log_routes"] = """
SELECT CASE WHEN event_type = 'purchase' THEN 'billing' WHEN log_id % 50 = 0 THEN 'default' WHEN namespace IN ('team-0', 'team-1') THEN 'first' ELSE 'rest' END AS route,
  namespace, count(*) AS n FROM v_logs GROUP BY ALL
"""


def log_strip_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.strip_reserved(log_table(spark, sf_dir), ["container.id", "k8s.pod.name"], ["event.type"])
    return out.groupBy("stripped", F.size("resource").alias("left")).agg(F.count("*").alias("n"))


SQL["log_strip_reserved"] = "SELECT 3 AS stripped, 1 AS left, count(*) AS n FROM v_logs"


def log_structured_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.create_map(F.lit("password"), F.md5(F.col("log_id").cast("string")), F.lit("note"), F.col("body"))
    out = log_table(spark, sf_dir, spread=True).select("log_id", logs.scrub_structured(body, _STEPS).alias("b"))
    return out.select("log_id", F.col("b")["password"].alias("password"), F.col("b")["note"].alias("note"))


SQL["log_structured_scrub"] = f"SELECT log_id, '[REDACTED]' AS password, {_scrubbed(_STEPS)} AS note FROM v_logs"


def log_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = log_table(spark, sf_dir).withColumn("ts_us", F.expr("ts_us div 3600"))
    return logs.rate_limit(hourly, ["namespace"], 5, "ts_us", ["ts_us", "log_id"]).select("log_id", "namespace")


SQL["log_rate_limit"] = "SELECT log_id, namespace FROM v_logs QUALIFY row_number() OVER (PARTITION BY namespace, (ts_us // 3600) // 1000000 ORDER BY ts_us // 3600, log_id) <= 5"


def log_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.throttle(log_table(spark, sf_dir), ["pod", "event_type"], 86_400_000_000, "ts_us", ["log_id"]).select("log_id", "pod", "event_type")


SQL["log_throttle"] = "SELECT log_id, pod, event_type FROM v_logs QUALIFY row_number() OVER (PARTITION BY pod, event_type, ts_us // 86400000000 ORDER BY ts_us, log_id) = 1"


def log_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = log_table(spark, sf_dir)
    replayed = table.unionByName(table.filter("log_id % 3 = 0"))
    return logs.first_seen(replayed, ["log_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


SQL["log_first_seen"] = "SELECT event_type, count(*) AS n FROM v_logs GROUP BY ALL"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.select("conv_id", (F.col("turn") * 10_000).alias("base"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).select("conv_id", (F.col("base") + F.col("pos")).alias("pos_no"), "text")


_LINES = "lines AS (SELECT conv_id, turn * 10000 + unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos_no, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM conversations)"


def log_cri_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.length("text") % 3 == 0, "P").otherwise("F")
    lines = _lines(spark, sf_dir).select("conv_id", "pos_no", F.concat(F.lit("2024-01-01T00:00:00Z stdout "), tag, F.lit(" "), F.col("text")).alias("line"))
    return logs.cri_lines(lines, ["conv_id"], "pos_no").select("conv_id", "first", "last", F.md5("body").alias("body_md5"))


SQL["log_cri_lines"] = f"""
WITH {_LINES},
runs AS (SELECT *, coalesce(sum((length(text) % 3 <> 0)::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM lines)
SELECT conv_id, min(pos_no) AS first, max(pos_no) AS last, md5(string_agg(text, '' ORDER BY pos_no)) AS body_md5 FROM runs GROUP BY conv_id, run
"""


def log_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("line", F.when(F.length("text") % 4 == 0, F.concat(F.lit("  at "), F.col("text"))).otherwise(F.concat(F.lit("x"), F.col("text"))))
    return logs.join_multiline(lines, ["conv_id"], "pos_no", max_lines=3).select("conv_id", "first", "last", "n_lines", "truncated", F.md5("body").alias("body_md5"))


SQL["log_multiline"] = f"""
WITH {_LINES},
marked AS (SELECT *, CASE WHEN length(text) % 4 = 0 THEN '  at ' || text ELSE 'x' || text END AS line FROM lines),
block AS (SELECT *, sum((length(text) % 4 <> 0)::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos_no) AS block FROM marked),
cut AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY pos_no) - 1) // 3 AS cut FROM block)
SELECT conv_id, min(pos_no) AS first, max(pos_no) AS last, count(*)::INTEGER AS n_lines, cut > 0 AS truncated, md5(string_agg(line, chr(10) ORDER BY pos_no)) AS body_md5
FROM cut GROUP BY conv_id, block, cut
"""

_CHAIN = logs.ChainConfig(lifts=[Lift("took_ms", "took")], rules=_RULES, routes=[("first", ["team-0"]), ("rest", ["team-*"])])


def log_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.run_log_chain(log_table(spark, sf_dir), _CHAIN, ["ts_us", "log_id"], source=["pod"])
    return out.select("log_id", "body", F.coalesce("severity_text", F.lit("")).alias("severity_text"), F.coalesce(F.col("attrs")["took"], F.lit("")).alias("took"), "route")


_DONE = "done AS (SELECT * REPLACE (%s AS body) FROM v_logs)" % _scrubbed(logs.redactions(["defaults"]))
_BETTER = f"coalesce(nullif(severity_text, ''), lower({_LEVEL}))"
_CHAIN_RULE = _RULE.replace(_SEVERITY, f"coalesce({_BETTER}, {_SEVERITY})")
SQL["log_chain"] = f"""
WITH {_DONE},
hit AS (SELECT *, {_CHAIN_RULE} AS rule FROM done),
nth AS (SELECT *, row_number() OVER (PARTITION BY rule, pod ORDER BY ts_us, log_id) - 1 AS n FROM hit)
SELECT log_id, body, coalesce({_BETTER}, '') AS severity_text, coalesce({_TOOK}, '') AS took, CASE WHEN namespace = 'team-0' THEN 'first' ELSE 'rest' END AS route
FROM nth WHERE rule IN (-1, 1) OR (rule = 3 AND n % 4 = 0)
"""

# --- metrics of log records

_HOUR = 3_600_000_000
_METRICS = [
    Metric("requests", labels=("event.type", "class=$http.status(_xx)"), resource_labels=("ns=$k8s.namespace.name",)),
    Metric("took", "histogram", "observe", value="took_ms", labels=("event.type",), bounds=(1000.0, 3000.0, 10000.0)),
    Metric("slowest", "gauge", "max", value_regexp=r"took[_ ](?:ms=|)(\d+)"),
    Metric("errors", exact=("__severity__=error",), labels=("who=$k8s.pod.name/pod-(\\d)\\d*/p$1/", "kind=fixed")),
    Metric("last_took", "gauge", "set", value="took_ms", resource_labels=("ns=$k8s.namespace.name",)),
    Metric("backlog", "gauge", "dec", exact=("event.type=click",)),
    Metric("size", "summary", "observe", value="took_ms"),
]


def _pairs(**labels: str) -> str:
    """A canonical label key in DuckDB, the labels in sorted order."""
    inner = ", ".join(f"CASE WHEN coalesce({v}, '') <> '' THEN '{k}=\"' || {v} || '\"' END" for k, v in sorted(labels.items(), key=lambda x: x[0]))
    return f"'{{' || concat_ws(', ', {inner}) || '}}'"


_NS = _pairs(ns="namespace")
_TOOK_N = f"try_cast({_TOOK} AS DOUBLE)"
_CLASS = f"CASE WHEN coalesce({_HTTP}, '') <> '' THEN substr({_HTTP}, 1, 1) || 'xx' END"
_EVENT = _pairs(**{"event.type": "event_type"})
_OBSERVED = f"""seen AS (
  SELECT log_id, ts_us, 'requests' AS metric, {_pairs(**{'event.type': 'event_type', 'class': _CLASS})} AS labels, {_NS} AS resource_labels, 1.0::DOUBLE AS value FROM v_logs
  UNION ALL SELECT log_id, ts_us, 'took', {_EVENT}, '{{}}', {_TOOK_N} FROM v_logs
  UNION ALL SELECT log_id, ts_us, 'slowest', '{{}}', '{{}}', try_cast(nullif(regexp_extract(body, 'took[_ ](?:ms=|)(\\d+)', 1), '') AS DOUBLE) FROM v_logs
  UNION ALL SELECT log_id, ts_us, 'errors', {_pairs(kind="'fixed'", who="regexp_replace(pod, 'pod-([0-9])[0-9]*', 'p' || chr(92) || '1', 'g')")}, '{{}}', 1.0 FROM v_logs WHERE {_SEVERITY} = 'error'
  UNION ALL SELECT log_id, ts_us, 'last_took', '{{}}', {_NS}, {_TOOK_N} FROM v_logs
  UNION ALL SELECT log_id, ts_us, 'backlog', '{{}}', '{{}}', 1.0 FROM v_logs WHERE event_type = 'click'
  UNION ALL SELECT log_id, ts_us, 'size', '{{}}', '{{}}', {_TOOK_N} FROM v_logs),
windows AS (
  SELECT metric, ts_us // {_HOUR * 24} AS "window", labels, resource_labels,
    CASE metric WHEN 'slowest' THEN max(value) WHEN 'last_took' THEN arg_max(value, {{'ts': ts_us, 'id': log_id}}) WHEN 'backlog' THEN -count(*)::DOUBLE ELSE sum(value) END AS value,
    count(*) AS count, sum(value) AS sum,
    CASE WHEN metric = 'took' THEN concat_ws(',', count(*) FILTER (WHERE value <= 1000), count(*) FILTER (WHERE value > 1000 AND value <= 3000), count(*) FILTER (WHERE value > 3000 AND value <= 10000), count(*) FILTER (WHERE value > 10000)) ELSE '' END AS buckets
  FROM seen WHERE value IS NOT NULL GROUP BY metric, ts_us // {_HOUR * 24}, labels, resource_labels)"""


def _windows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Windows of all metrics, or of those named."""
    return log_metrics.log_metrics(log_table(spark, sf_dir, spread=True), [m for m in _METRICS if not names or m.name in names], 24 * _HOUR)


def log_derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("buckets", F.coalesce(F.array_join(F.col("buckets").cast("array<string>"), ","), F.lit("")))


SQL["log_derived_metrics"] = f"WITH {_OBSERVED} SELECT * FROM windows"


def log_gauge_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_metrics.running_gauge(_windows(spark, sf_dir, "backlog", "errors")).select("metric", "labels", "window", "total")


SQL["log_gauge_running"] = f'WITH {_OBSERVED} SELECT metric, labels, "window", sum(value) OVER (PARTITION BY metric, labels ORDER BY "window" ROWS UNBOUNDED PRECEDING) AS total FROM windows WHERE metric IN (\'backlog\', \'errors\')'


def log_gauge_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _windows(spark, sf_dir, "errors")
    return log_metrics.held(some, ["labels"], "window", "value").select("labels", "window", "value")


_SPINE = """kw AS (SELECT labels, "window" AS w, value FROM windows WHERE metric = 'errors'),
spine AS (SELECT labels, unnest(range(min(w), (SELECT max(w) FROM kw) + 1)) AS w FROM kw GROUP BY labels)"""
SQL["log_gauge_held"] = f'WITH {_OBSERVED}, {_SPINE} SELECT labels, w AS "window", last_value(value IGNORE NULLS) OVER (PARTITION BY labels ORDER BY w ROWS UNBOUNDED PRECEDING) AS value FROM spine LEFT JOIN kw USING (labels, w)'


def log_series_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _windows(spark, sf_dir, "errors")
    return log_metrics.expired(some, ["labels"], "window", 1, 2)


SQL["log_series_expiry"] = f"""
WITH {_OBSERVED}, {_SPINE},
seen2 AS (SELECT labels, w, w - last_value(kw.w IGNORE NULLS) OVER (PARTITION BY labels ORDER BY spine.w ROWS UNBOUNDED PRECEDING) AS idle FROM spine LEFT JOIN kw USING (labels, w))
SELECT labels, w AS "window", CASE WHEN idle > 1 THEN 'zeroed' ELSE 'live' END AS state FROM seen2 WHERE idle <= 3
"""


def log_text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", *(cut_utf8(F.coalesce("text", F.lit("")), n).alias(f"cut_{n}") for n in (31, 256)))


_CUT = "t[1:list_max([k for k in range(0, {0} + 1) if strlen(t[1:k]) <= {0}])]"
SQL["log_text_cut"] = f"SELECT doc_id, {_CUT.format(31)} AS cut_31, {_CUT.format(256)} AS cut_256 FROM (SELECT doc_id, coalesce(text, '')[1:300] AS t FROM documents)"
QUERIES = {name: globals()[name] for name in SQL}
