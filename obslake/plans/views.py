"""Telemetry-shaped views over the driver's tables, as SQL that both Spark and DuckDB run.

Only the functions in a Dialect differ between the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations")


@dataclass(frozen=True)
class Dialect:
    micros: str
    idiv: str

    def us(self, ts: str) -> str:
        """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
        return self.micros.format(ts)

    def div(self, a: str, b: str) -> str:
        return f"(({a}) {self.idiv} ({b}))"


SPARK = Dialect("(cast(datediff({0}, date'1970-01-01') as bigint) * 86400000000 + cast(hour({0}) as bigint) * 3600000000 + cast(minute({0}) as bigint) * 60000000 + cast(extract(second from {0}) * 1000000 as bigint))", "div")
DUCK = Dialect("epoch_us({0})", "//")


def spans(d: Dialect) -> str:
    """Two halves of a call for each order line; parents chain the lines of an order into one trace."""
    start = f"({d.us('l_shipdate')} * 1000 + cast(l_linenumber as bigint) * 1000000000)"
    factor = "(case when l_discount > 0.08 then 40 else 1 end)"
    arrival = f"({d.div(start, '1000000')} + l_linenumber * 1000 + (case when l_tax > 0.07 then 20000 else 0 end))"
    common = """
      md5(cast(l_orderkey as string)) as trace_id, concat('op-', cast(l_partkey % 10 as string)) as name,
      case when l_quantity > 45 then 'ERROR' else 'UNSET' end as status,
      case when l_quantity > 45 then '500' else '200' end as http_status,
      case when l_discount > 0.08 then 'true' else 'false' end as slow,
      concat('team-', cast(l_suppkey % 4 as string)) as namespace"""
    return f"""
    select {common},
      substr(md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))), 1, 16) as span_id,
      case when l_linenumber = 1 then '' else substr(md5(concat('s-', cast(l_orderkey as string), '-', cast(l_linenumber - 1 as string))), 1, 16) end as parent_span_id,
      case when l_partkey % 97 = 0 then '' else concat('svc-', cast(l_suppkey % 7 as string)) end as service,
      case when l_linenumber = 7 then 'INTERNAL' when l_returnflag = 'A' and l_linenumber = 5 then 'PRODUCER' else 'CLIENT' end as kind,
      {start} as start_ns, {start} + cast(l_quantity as bigint) * 7000000 * {factor} as end_ns, {arrival} as arrival_ms,
      case when l_suppkey % 3 = 0 then concat('peer-', cast(l_suppkey % 5 as string)) end as peer_service,
      case when l_suppkey % 11 = 0 then 'postgresql' end as db_system
    from lineitem where not (l_returnflag = 'N' and l_linenumber = 4)
    union all
    select {common},
      substr(md5(concat('s-', cast(l_orderkey as string), '-', cast(l_linenumber as string))), 1, 16),
      substr(md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))), 1, 16),
      concat('svc-', cast(7 + l_partkey % 5 as string)),
      case when l_linenumber = 7 then 'INTERNAL' when l_returnflag = 'A' and l_linenumber = 5 then 'CONSUMER' else 'SERVER' end,
      {start} + 1000000, {start} + 1000000 + cast(l_quantity as bigint) * 6300000 * {factor}, {arrival} + 1000,
      null, null
    from lineitem where l_returnflag <> 'R'"""


def logs(d: Dialect) -> str:
    """One record for each event; bodies are JSON, logfmt or plain by turns."""
    status = "cast(200 + (event_id % 4) * 100 as string)"
    level = "case event_type when 'error' then 'ERROR' when 'view' then 'DEBUG' else 'INFO' end"
    milli = "cast(cast(round(value * 100) as bigint) as string)"
    return f"""
    select event_id as log_id, {d.us('ts')} as ts_us, user_id, event_type, value,
      concat('team-', cast(user_id % 4 as string)) as namespace, concat('pod-', cast(user_id as string)) as pod,
      concat(md5(cast(user_id as string)), md5(cast(user_id as string))) as container_id,
      case when event_id % 5 = 0 then null when event_type = 'error' then 'error' when event_type = 'view' then 'debug' else 'info' end as severity_text,
      case event_type when 'error' then 17 when 'view' then 5 else 9 end as severity_number,
      case event_id % 4
        when 0 then concat('{{"level":"', {level}, '","user":', cast(user_id as string), ',"http":{{"status":', {status}, '}},"took_ms":', {milli}, ',"trace_id":"', md5(cast(event_id as string)), '","msg":"request ', event_type, '"}}')
        when 1 then concat('level=', lower({level}), ' status=', {status}, ' took_ms=', {milli}, ' msg="user ', cast(user_id as string), ' did ', event_type, '"')
        when 2 then concat('request ', event_type, ' took ', {milli}, 'ms password=', substr(md5(cast(event_id as string)), 1, 12), ' user=', cast(user_id as string))
        else concat('Authorization: Bearer ', md5(cast(event_id as string)), ' from ', event_type, '-', cast(user_id as string), '@example.com') end as body
    from events"""


def samples(d: Dialect) -> str:
    """Scrapes: for each user and hour a counter, a gauge, and a histogram of values with some malformed rows."""
    hour = d.div(d.us("ts"), "3600000000")
    base = f"select user_id, {hour} as hour, value, event_id, event_type from events"
    les = ("5", "10", "20", "40", "+Inf")
    parts = [
        f"select user_id, hour, 'requests_total' as name, 'requests' as family, 'counter' as role, cast(null as string) as le, cast(count(*) as double) as value, 0 as pos from e group by user_id, hour",
        f"select user_id, hour, 'temperature' as name, 'temperature' as family, 'gauge' as role, cast(null as string) as le, max(value) as value, 1 as pos from e group by user_id, hour",
        f"select user_id, hour, 'latency_sum' as name, 'latency' as family, 'histogram_sum' as role, cast(null as string) as le, cast(sum(cast(round(value * 100) as bigint)) as double) as value, 2 as pos from e group by user_id, hour",
        f"select user_id, hour, 'latency_count' as name, 'latency' as family, 'histogram_count' as role, cast(null as string) as le, cast(case when user_id % 13 = 0 then -1 else count(*) end as double) as value, 3 as pos from e group by user_id, hour",
    ]
    for k, le in enumerate(les):
        bound = "1e308" if le == "+Inf" else le
        parts.append(f"select user_id, hour, 'latency_bucket' as name, 'latency' as family, 'histogram_bucket' as role, case when user_id % 17 = 0 and {k} = 1 then 'x' else '{le}' end as le, cast(sum(case when value <= {bound} then 1 else 0 end) as double) as value, {10 + k} as pos from e group by user_id, hour")
    if d is SPARK:
        # the same rows from one pass: an aggregation of each user and hour, laid out afterwards
        heads = {"requests_total": ("requests", "counter", "n", 0), "temperature": ("temperature", "gauge", "m", 1), "latency_sum": ("latency", "histogram_sum", "s", 2), "latency_count": ("latency", "histogram_count", "case when user_id % 13 = 0 then -1 else n end", 3)}
        rows = [f"named_struct('name', '{name}', 'family', '{family}', 'role', '{role}', 'le', cast(null as string), 'value', cast({value} as double), 'pos', {pos})" for name, (family, role, value, pos) in heads.items()]
        rows += [f"named_struct('name', 'latency_bucket', 'family', 'latency', 'role', 'histogram_bucket', 'le', {f"case when user_id % 17 = 0 then 'x' else '{le}' end" if k == 1 else f"'{le}'"}, 'value', cast(b{k} as double), 'pos', {10 + k})" for k, le in enumerate(les)]
        buckets = ", ".join(f"sum(case when value <= {'1e308' if le == '+Inf' else le} then 1 else 0 end) as b{k}" for k, le in enumerate(les))
        sums = f"select user_id, hour, count(*) as n, max(value) as m, sum(cast(round(value * 100) as bigint)) as s, {buckets} from e group by user_id, hour"
        union = f"select user_id, hour, inline(array({', '.join(rows)})) from ({sums})"
    else:
        union = "\n    union all ".join(parts)
    return f"with e as ({base}) select s.*, concat(cast(user_id as string), '/', cast(hour as string)) as scrape_id, hour * 3600000 as scrape_ms, concat('team-', cast(user_id % 4 as string)) as namespace, concat('pod-', cast(user_id as string)) as pod from ({union}) s"


def readings(d: Dialect) -> str:
    """Cumulative CPU readings of a container: each user's events, one microsecond of CPU for a hundredth of value."""
    us = d.us("ts")
    return f"""
    select user_id, event_id, {us} as ts_us,
      sum(cast(round(value * 10000) as bigint)) over (partition by user_id, epoch_no order by {us}, event_id rows between unbounded preceding and current row) as usage_usec,
      cast(round(value * 1000000) as bigint) as memory_bytes, cast(round(value * 300000) as bigint) as inactive_bytes
    from (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as epoch_no from events)"""


def pods(d: Dialect) -> str:
    """One pod for each customer."""
    return """
    select c_custkey as pod_no, md5(concat('pod', cast(c_custkey as string))) as uid, concat('pod-', cast(c_custkey as string)) as name,
      concat('team-', cast(c_custkey % 4 as string)) as namespace, concat('node-', cast(c_nationkey as string)) as node,
      lower(c_mktsegment) as app, concat('rs-', cast(c_custkey % 25 as string)) as owner_name, md5(concat('rs', cast(c_custkey % 25 as string))) as owner_uid,
      case when c_custkey % 19 = 0 then 'Succeeded' when c_custkey % 23 = 0 then 'Failed' when c_custkey % 29 = 0 then 'Pending' else 'Running' end as phase,
      c_custkey % 31 = 0 as terminating, c_custkey % 37 = 0 as host_network,
      case when c_custkey % 41 = 0 then '' when c_custkey % 10 = 0 then concat('10.0.0.', cast(c_custkey % 7 as string)) else concat('10.', cast((c_custkey % 60000) % 250 as string), '.', cast(c_custkey % 199 as string), '.', cast(c_custkey % 241 as string)) end as ip,
      case when c_custkey % 3 = 0 then 'true' when c_custkey % 3 = 1 then 'false' end as scrape_annotation,
      case when c_custkey % 5 = 0 then '8080,metrics' when c_custkey % 5 = 1 then 'metrics' when c_custkey % 5 = 2 then '9090' end as port_annotation,
      case when c_custkey % 7 = 0 then 'stats' when c_custkey % 7 = 1 then '/custom' end as path_annotation,
      concat(md5(cast(c_custkey as string)), md5(cast(c_custkey as string))) as container_id,
      cast(round(c_acctbal * 100) as bigint) as claim_seq
    from customer"""


def services(d: Dialect) -> str:
    """One service for each supplier."""
    return """
    select s_suppkey as service_no, md5(concat('svc', cast(s_suppkey as string))) as uid, concat('svc-', cast(s_suppkey as string)) as name,
      concat('team-', cast(s_suppkey % 4 as string)) as namespace,
      case s_suppkey % 6 when 0 then 'automobile' when 1 then 'building' when 2 then 'furniture' when 3 then 'household' when 4 then 'machinery' end as selector_app,
      case when s_suppkey % 2 = 0 then concat('node-', cast(s_nationkey as string)) end as selector_node,
      case when s_suppkey % 3 = 0 then 'true' end as scrape_annotation,
      case when s_suppkey % 4 = 0 then 'metrics' else '8080' end as target_port
    from supplier"""


VIEWS = {"v_spans": spans, "v_logs": logs, "v_samples": samples, "v_readings": readings, "v_pods": pods, "v_services": services}


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put in front as common table expressions; sql may begin with WITH."""
    used = [f"{name} AS ({make(DUCK)})" for name, make in VIEWS.items() if name in sql]
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if body[:4].upper() == "WITH":
        body = f", {body[14 if recursive else 4:].strip()}"
    if not used:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(used)} {body}"


def view(spark: SparkSession, sf_dir: str, name: str, spread: str = "") -> DataFrame:
    """A view over the Parquet tables of sf_dir; spread: a column by which their rows are dealt over all tasks first, since a small file is read by few tasks."""
    sql = VIEWS[name](SPARK)
    for t in TABLES:
        if f"from {t}" in sql:
            table = f"parquet.`{sf_dir}/{t}.parquet`"
            sql = sql.replace(f"from {t}", f"from (select /*+ repartition({spread}) */ * from {table})" if spread else f"from {table}")
    return spark.sql(sql)


def attributes(df: DataFrame, out: str, **named: str) -> DataFrame:
    """df with a map column of the given columns' values, nulls left out; keys may hold double underscores for dots."""
    pairs = [x for key, column in named.items() for x in (F.lit(key.replace("__", ".")), F.col(column).cast("string"))]
    return df.withColumn(out, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with attrs and resource maps."""
    df = attributes(view(spark, sf_dir, "v_spans"), "attrs", http__status_code="http_status", peer__service="peer_service", db__system="db_system", slow="slow")
    return attributes(df, "resource", service__name="service", k8s__namespace__name="namespace").drop("http_status", "peer_service", "db_system", "slow", "namespace")


def log_table(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Log records with attrs and resource maps; spread: dealt over all tasks first, for work that is much for a row, since a small file of events is read by few tasks."""
    df = view(spark, sf_dir, "v_logs")
    df = attributes(df.repartition("log_id") if spread else df, "resource", k8s__namespace__name="namespace", k8s__pod__name="pod", container__id="container_id")
    return df.withColumn("attrs", F.create_map(F.lit("event.type"), F.col("event_type")))
