"""Queries of rules that depend on earlier verdicts, with recursive DuckDB SQL as counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, late, logs, sampling, usage
from .views import log_table, span_table, view

SQL: dict[str, str] = {}
_DAY, _HOUR = 86_400_000_000, 3_600_000_000


def _fold_sql(events: str, key: str, full: int, token: int, gain: int, debt: bool, out: str) -> str:
    """A bucket's fold over events (id, key, at, n, i): tokens in parts, one event of each key in a round."""
    need = f"least(e.n * {token}, {full})" if debt else f"e.n * {token}"
    return f"""
WITH RECURSIVE {events},
fold AS (
  SELECT DISTINCT {key} AS k, 0::BIGINT AS i, {full}::HUGEINT AS tokens, NULL::BIGINT AS last, NULL::VARCHAR AS id, false AS admitted FROM ev
  UNION ALL
  SELECT k, i, held - CASE WHEN held >= need THEN n * {token} ELSE 0 END, tm, id, held >= need FROM (
    SELECT f.k, e.i, e.tm, e.id, e.n, {need} AS need, least({full}::HUGEINT, f.tokens + greatest(coalesce(e.tm - f.last, 0), 0)::HUGEINT * {gain}) AS held
    FROM fold f JOIN ev e ON e.{key} = f.k AND e.i = f.i + 1))
{out}"""


def log_rate_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pod's records through a bucket of two that gains one in ten days."""
    return logs.bucket_limit(log_table(spark, sf_dir), ["pod"], 1 / 864_000, 2, "ts_us", ["log_id"]).select("log_id", "pod")


SQL["log_rate_bucket"] = _fold_sql(
    "ev AS (SELECT log_id::VARCHAR AS id, pod, ts_us AS tm, 1 AS n, row_number() OVER (PARTITION BY pod ORDER BY ts_us, log_id) AS i FROM v_logs)",
    "pod", 2 * 864_000 * 10**6, 864_000 * 10**6, 1, False, "SELECT id::BIGINT AS log_id, k AS pod FROM fold WHERE admitted",
)


def tail_rate_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace with what the bucket of its collector said: four spans a day, so large traces leave debts."""
    traces = span_table(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.min("arrival_ms").alias("first_ms"))
    traces = traces.withColumn("collector", F.substring("trace_id", 1, 2))
    return sampling.rate_limiting(traces, 4 / 86_400, ("collector",)).select("trace_id", "collector", "n_spans", "admitted")


SQL["tail_rate_bucket"] = _fold_sql(
    """t AS (SELECT trace_id, count(*) AS n, min(arrival_ms) * 1000 AS tm FROM v_spans GROUP BY trace_id),
ev AS (SELECT trace_id AS id, left(trace_id, 2) AS collector, tm, n, row_number() OVER (PARTITION BY left(trace_id, 2) ORDER BY tm, trace_id) AS i FROM t)""",
    "collector", 21_600 * 10**6, 21_600 * 10**6, 1, True, "SELECT id AS trace_id, k AS collector, n AS n_spans, admitted FROM fold JOIN t ON t.trace_id = id",
)


def span_rate_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each service and trace prefix through a bucket of one span in six hours."""
    spans = view(spark, sf_dir, "v_spans").withColumns({"at_us": F.col("arrival_ms") * 1000, "part": F.substring("trace_id", 1, 2)})
    spans = spans.select("part", "at_us", "arrival_ms", "span_id", "start_ns", "end_ns", "name")
    return sampling.span_rate_limit(spans, 1 / 21_600, "at_us", ["span_id", "start_ns", "end_ns", "name"], ("part",)).groupBy("part").agg(F.count("*").alias("n"), F.sum("arrival_ms").alias("at_ms"))


SQL["span_rate_bucket"] = _fold_sql(
    "ev AS (SELECT span_id AS id, left(trace_id, 2) AS part, arrival_ms * 1000 AS tm, 1 AS n, row_number() OVER (PARTITION BY left(trace_id, 2) ORDER BY arrival_ms, span_id, start_ns, end_ns, name) AS i FROM v_spans)",
    "part", 21_600 * 10**6, 21_600 * 10**6, 1, True, "SELECT k AS part, count(*) AS n, sum(last // 1000)::BIGINT AS at_ms FROM fold WHERE admitted GROUP BY k",
)


def log_first_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of each user, at most once in a day from the first, in a table of three for each user; and where one found it full."""
    out = folds.throttle(log_table(spark, sf_dir), ["event_type", "severity_text"], "ts_us", ["log_id"], _DAY, 3, ("pod",))
    return out.filter("allowed or saturated").select("log_id", "pod", "allowed", "saturated")


SQL["log_first_throttle"] = f"""
WITH RECURSIVE
ev AS (SELECT log_id, pod, ts_us AS tm, event_type || '/' || coalesce(severity_text, '?') AS name, row_number() OVER (PARTITION BY pod ORDER BY ts_us, log_id) AS i FROM v_logs),
fold AS (
  SELECT DISTINCT pod, 0::BIGINT AS i, [{{'k': '', 't': 0::BIGINT}}][2:] AS seen, false AS told, NULL::BIGINT AS log_id, false AS allowed, false AS saturated FROM ev
  UNION ALL
  SELECT pod, i, CASE WHEN known AND fresh THEN seen WHEN known THEN list_append(others, {{'k': name, 't': tm}}) WHEN len(seen) < 3 THEN list_append(seen, {{'k': name, 't': tm}})
      WHEN len(live) < 3 THEN list_append(live, {{'k': name, 't': tm}}) ELSE live END,
    told OR NOT known AND len(seen) >= 3 AND len(live) >= 3, log_id,
    CASE WHEN known THEN NOT fresh ELSE len(seen) < 3 OR len(live) < 3 END, NOT told AND NOT known AND len(seen) >= 3 AND len(live) >= 3
  FROM (
    SELECT f.pod, e.i, f.seen, f.told, e.log_id, e.name, e.tm, len(list_filter(f.seen, lambda x: x.k = e.name)) > 0 AS known,
      len(list_filter(f.seen, lambda x: x.k = e.name AND e.tm - x.t < {_DAY})) > 0 AS fresh,
      list_filter(f.seen, lambda x: x.k <> e.name) AS others, list_filter(f.seen, lambda x: e.tm - x.t < {_DAY}) AS live
    FROM fold f JOIN ev e ON e.pod = f.pod AND e.i = f.i + 1))
SELECT log_id, pod, allowed, saturated FROM fold WHERE allowed OR saturated
"""


def log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each kind of event and pod, for the first hundred such in each namespace."""
    out = folds.throttle(log_table(spark, sf_dir), ["pod", "event_type"], "ts_us", ["log_id"], 0, 100, ("namespace",))
    return out.filter("allowed").select("log_id", "namespace")


SQL["log_once"] = """
WITH f AS (SELECT log_id, namespace, ts_us, row_number() OVER (PARTITION BY namespace, pod, event_type ORDER BY ts_us, log_id) AS n FROM v_logs)
SELECT log_id, namespace FROM f WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ts_us, log_id) <= 100
"""


def tail_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a day's silence, and those whose trace was decided in the forty days before them."""
    spans = span_table(spark, sf_dir).withColumn("arrival_ts", F.timestamp_millis("arrival_ms"))
    out = late.settled_sessions(late.trace_sessions(spans, [sampling.status_code("errors", ["ERROR"])], "1 day"), 40 * _DAY // 1000)
    return out.drop("spans")


SQL["tail_settled"] = f"""
WITH RECURSIVE
marked AS (SELECT trace_id, arrival_ms, status, coalesce(arrival_ms - lag(arrival_ms) OVER (PARTITION BY trace_id ORDER BY arrival_ms) > {_DAY // 1000}, true) AS begins FROM v_spans),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY trace_id ORDER BY arrival_ms) AS g FROM marked),
sessions AS (SELECT trace_id, g::BIGINT AS i, min(arrival_ms) AS start_ms, max(arrival_ms) + {_DAY // 1000} AS end_ms, count(*) AS n_spans, bool_or(status = 'ERROR') AS failed FROM numbered GROUP BY trace_id, g),
fold AS (
  SELECT trace_id, i, end_ms + {40 * _DAY // 1000} AS until, failed, false AS late FROM sessions WHERE i = 1
  UNION ALL
  SELECT s.trace_id, s.i, CASE WHEN s.start_ms < f.until THEN f.until ELSE s.end_ms + {40 * _DAY // 1000} END, CASE WHEN s.start_ms < f.until THEN f.failed ELSE s.failed END, s.start_ms < f.until
  FROM fold f JOIN sessions s ON s.trace_id = f.trace_id AND s.i = f.i + 1)
SELECT trace_id, start_ms, end_ms, n_spans, CASE WHEN fold.failed THEN 'errors' ELSE '' END AS policy, CASE WHEN fold.failed THEN 'sample' ELSE 'drop' END AS verdict, late
FROM fold JOIN sessions USING (trace_id, i)
"""


def cpu_rates_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU rates over six hours at least."""
    out = usage.cpu_rates(view(spark, sf_dir, "v_readings"), "user_id", "ts_us", 6 * _HOUR)
    return out.select("user_id", "event_id", "working_set", F.round(F.col("cores") * 1e6, 3).alias("micro_cores"))


SQL["cpu_rates_apart"] = f"""
WITH RECURSIVE
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, usage_usec) AS i FROM v_readings),
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS tm, NULL::BIGINT AS used, NULL::DOUBLE AS cores FROM ev
  UNION ALL
  SELECT user_id, i, CASE WHEN taken THEN ts_us ELSE tm END, CASE WHEN taken THEN usage_usec ELSE used END, CASE WHEN taken AND usage_usec >= used AND ts_us > tm THEN (usage_usec - used)::DOUBLE / (ts_us - tm) END
  FROM (SELECT f.user_id, e.i, f.tm, f.used, e.ts_us, e.usage_usec::BIGINT AS usage_usec, f.tm IS NULL OR e.usage_usec < f.used OR e.ts_us - f.tm >= {6 * _HOUR} AS taken
    FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id, greatest(memory_bytes - inactive_bytes, 0) AS working_set, round(cores * 1e6, 3) AS micro_cores FROM ev JOIN fold USING (user_id, i)
"""

QUERIES = {name: globals()[name] for name in SQL}
