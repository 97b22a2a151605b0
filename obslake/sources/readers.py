"""Readers of telemetry files and documents. Each has a table function for parsed input, so that it works on streams as well."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.scalars import arm_id, cut_utf8, file_identity, glob_match, path_attributes
from ..operators.samples import parse_exposition


@dataclass(frozen=True)
class LogSource:
    """Files by globs over their path; static attributes, patterns whose groups become attributes, namespaces."""

    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    path_patterns: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()
    denied_namespaces: tuple[str, ...] = ()

    def claims(self, path: Column) -> Column:
        some = lambda globs, value: _any([glob_match(g, value) for g in globs])
        namespace = F.coalesce(file_identity(path)["namespace"], F.lit(""))
        out = some(self.include, path) & ~some(self.exclude, path) & ~some(self.denied_namespaces, namespace)
        return out & some(self.namespaces, namespace) if self.namespaces else out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def claimed(files: DataFrame, sources: list[LogSource], path: str = "path") -> DataFrame:
    """files with source (number of the first source that claims the path) and resource; unclaimed files go."""
    own = F.coalesce(*(F.when(s.claims(F.col(path)), k) for k, s in enumerate(sources)), F.lit(None).cast("int"))
    resource = maps.empty()
    for k, s in enumerate(sources):
        static = F.create_map(*(x for kv in s.attributes.items() for x in map(F.lit, kv))) if s.attributes else maps.empty()
        found = path_attributes(F.col(path), list(s.path_patterns)) if s.path_patterns else maps.empty()
        resource = F.when(F.col("source") == k, maps.merged(static, found)).otherwise(resource)
    return files.withColumn("source", own).filter("source is not null").withColumn("resource", resource)


def read_log_files(spark: SparkSession, root: str, sources: list[LogSource], modified_after: str | None = None, stream: bool = False) -> DataFrame:
    """Lines (path, line, source, resource) of the files under root; compressed files are read as Hadoop's codecs do."""
    reader = (spark.readStream if stream else spark.read).format("text").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return claimed(lines, sources)


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files that hold one scrape body each."""
    bodies = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("scrape_id"), F.col("value").alias("body"))
    return parse_exposition(bodies)


_EVENT = (
    "metadata struct<name:string,namespace:string,uid:string,creationTimestamp:string,resourceVersion:string>, "
    "involvedObject struct<kind:string,namespace:string,name:string,uid:string>, reason string, message string, type string, count long, "
    "firstTimestamp string, lastTimestamp string, eventTime string, series struct<count:long,lastObservedTime:string>"
)


def k8s_events(raw: DataFrame, column: str = "value", pods: DataFrame | None = None) -> DataFrame:
    """Log records of Kubernetes Event objects: what happened as body, Warning as warn, the most exact of their times, the pod as resource if its uid agrees.

    Deleted events, and text that isn't an Event, go. pods: namespace, name, uid, resource.
    """
    e = raw.select(F.from_json(column, _EVENT).alias("e"), F.get_json_object(column, "$.eventType").alias("_change")).filter("e.metadata is not null and coalesce(_change, '') <> 'DELETED'")
    when = F.coalesce("e.series.lastObservedTime", "e.lastTimestamp", "e.eventTime", "e.firstTimestamp", "e.metadata.creationTimestamp")
    obj = F.col("e.involvedObject")
    named = F.create_map(F.lit("k8s.event.reason"), F.col("e.reason"), F.lit("k8s.event.name"), F.col("e.metadata.name"), F.lit("k8s.event.uid"), F.col("e.metadata.uid"), F.lit("k8s.event.count"), F.coalesce("e.series.count", "e.count").cast("string"), F.lit("k8s.object.kind"), obj["kind"])
    base = F.create_map(F.lit("k8s.namespace.name"), obj["namespace"], F.concat(F.lit("k8s."), F.lower(obj["kind"]), F.lit(".name")), obj["name"])
    out = e.select(
        F.coalesce(F.nullif(F.col("e.message"), F.lit("")), "e.reason").alias("body"), when.alias("time"), F.when(F.col("e.type") == "Warning", "warn").otherwise("info").alias("severity_text"),
        F.when(F.col("e.type") == "Warning", 13).otherwise(9).alias("severity_number"), maps.non_empty(named).alias("attrs"), maps.non_empty(base).alias("resource"),
        obj["namespace"].alias("_ns"), obj["name"].alias("_name"), F.coalesce(obj["uid"], F.lit("")).alias("_uid"), obj["kind"].alias("_kind"),
    )
    if pods is not None:
        p = pods.select(F.col("namespace").alias("_pns"), F.col("name").alias("_pname"), F.col("uid").alias("_puid"), F.col("resource").alias("_pres"))
        out = out.join(p, (F.col("_kind") == "Pod") & (F.col("_ns") == F.col("_pns")) & (F.col("_name") == F.col("_pname")) & ((F.col("_uid") == "") | (F.col("_uid") == F.col("_puid"))), "left")
        out = out.withColumn("resource", maps.merged(F.col("resource"), F.col("_pres"))).drop("_pns", "_pname", "_puid", "_pres")
    return out.drop("_ns", "_name", "_uid", "_kind")


def azure_records(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row (record string) for each record of {"records": [...]}, a bare array, or one object; text that is none of these goes."""
    text = F.trim(F.col(column))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.from_json(F.get_json_object(text, "$.records"), "array<string>"))
    alone = F.when(text.startswith("{") & F.get_json_object(text, "$").isNotNull() & F.get_json_object(text, "$.records").isNull(), F.array(text))
    return raw.select(F.explode(F.coalesce(listed, alone)).alias("record"))


#: Levels of cloud diagnostics by band.
_LEVELS = {"fatal": ("critical",), "error": ("error",), "warn": ("warning",), "info": ("informational", "information", "notice"), "debug": ("verbose", "debug")}


def azure_logs(records: DataFrame) -> DataFrame:
    """Log records of diagnostics records: the message or the record as body, level, identity of the resource."""
    at = lambda k: F.get_json_object("record", f"$.{k}")
    level, band = F.lower(at("level")), F.lit("")
    for name, words in _LEVELS.items():
        band = F.when(level.isin(*words), name).otherwise(band)
    identity = arm_id(at("resourceId"))
    attrs = F.create_map(*(x for k, c in (("azure.category", at("category")), ("azure.operation", at("operationName")), ("azure.result", at("resultType")), ("azure.correlation_id", at("correlationId")), ("azure.tenant_id", at("tenantId"))) for x in (F.lit(k), c)))
    resource = F.create_map(*(x for k, c in (("cloud.account.id", identity["subscription"]), ("azure.resource_group", identity["group"]), ("azure.resource_type", identity["type"]), ("azure.resource_name", identity["name"]), ("cloud.resource_id", F.lower(at("resourceId")))) for x in (F.lit(k), c)))
    return records.filter(at("metricName").isNull()).select(at("time").alias("time"), F.coalesce(at("properties.message"), at("resultDescription"), F.col("record")).alias("body"), band.alias("severity_text"), maps.non_empty(attrs).alias("attrs"), maps.non_empty(resource).alias("resource"))


def azure_metrics(records: DataFrame) -> DataFrame:
    """(metric, time, timegrain, resource_id, value): a gauge azure.<metric>.<aggregate> for each aggregate that a record has."""
    at = lambda k: F.get_json_object("record", f"$.{k}")
    rows = F.array(*(F.struct(F.concat(F.lit("azure."), F.lower(at("metricName")), F.lit(f".{a}")).alias("metric"), at(a).try_cast("double").alias("value")) for a in ("count", "total", "minimum", "maximum", "average")))
    return records.filter(at("metricName").isNotNull()).select(at("time").alias("time"), at("timeGrain").alias("timegrain"), F.lower(at("resourceId")).alias("resource_id"), F.inline(rows)).filter("value is not null")


_FS = "struct<availableBytes:double,capacityBytes:double,usedBytes:double,inodes:double,inodesFree:double,inodesUsed:double>"
_SUMMARY = (
    f"node struct<nodeName:string,fs:{_FS},runtime:struct<imageFs:{_FS},containerFs:{_FS}>,rlimit:struct<maxpid:double,curproc:double>>, "
    f"pods array<struct<podRef:struct<name:string,namespace:string,uid:string>,`ephemeral-storage`:{_FS},process_stats:struct<process_count:double>,"
    f"containers:array<struct<name:string,rootfs:{_FS},logs:{_FS}>>,volume:array<struct<name:string,usedBytes:double,capacityBytes:double,availableBytes:double,inodes:double,inodesFree:double,inodesUsed:double,pvcRef:struct<name:string>>>>>"
)
_FS_FIELDS = (("available_bytes", "availableBytes"), ("capacity_bytes", "capacityBytes"), ("used_bytes", "usedBytes"), ("inodes", "inodes"), ("inodes_free", "inodesFree"), ("inodes_used", "inodesUsed"))


def kubelet_summary(raw: DataFrame, column: str = "value") -> DataFrame:
    """(metric, node, namespace, pod, container, volume, fs_type, value) of kubelet summary documents; elements without a name go."""
    doc = raw.select(F.from_json(column, _SUMMARY).alias("d"))
    none = F.lit(None).cast("string")

    def fields(prefix: str, c: Column) -> list[Column]:
        return [F.struct(F.lit(f"{prefix}.{n}").alias("metric"), c[f].alias("value")) for n, f in _FS_FIELDS]

    keys = ("node", "namespace", "pod", "container", "volume", "fs_type")

    def rows(df: DataFrame, structs: list[Column], **of: Column) -> DataFrame:
        return df.select(*(of.get(k, none).alias(k) for k in keys), F.inline(F.array(*structs))).filter("value is not null").select("metric", *keys, "value")

    node = F.col("d.node.nodeName")
    pods = doc.select(node.alias("node"), F.explode("d.pods").alias("p")).filter("coalesce(p.podRef.name, '') <> ''")
    of_pod = {"node": F.col("node"), "namespace": F.col("p.podRef.namespace"), "pod": F.col("p.podRef.name")}
    inner = pods.select("node", "p", F.explode("p.containers").alias("c")).filter("coalesce(c.name, '') <> ''")
    volumes = pods.select("node", "p", F.explode("p.volume").alias("v")).filter("coalesce(v.name, '') <> ''")
    process = F.struct(F.lit("k8s.pod.processes").alias("metric"), F.col("p.process_stats.process_count").alias("value"))
    limits = [F.struct(F.lit(m).alias("metric"), F.col(f"d.node.rlimit.{f}").alias("value")) for m, f in (("k8s.node.processes.max", "maxpid"), ("k8s.node.processes", "curproc"))]
    parts = [
        rows(doc, [*fields("k8s.node.fs", F.col("d.node.fs")), *limits], node=node),
        *(rows(doc, fields("k8s.node.fs", F.col(f"d.node.runtime.{f}")), node=node, fs_type=F.lit(t)) for f, t in (("imageFs", "image"), ("containerFs", "container"))),
        rows(pods, [*fields("k8s.pod.ephemeral", F.col("p.`ephemeral-storage`")), process], **of_pod),
        *(rows(inner, fields("k8s.container.fs", F.col(f"c.{f}")), **of_pod, container=F.col("c.name"), fs_type=F.lit(f)) for f in ("rootfs", "logs")),
        rows(volumes, fields("k8s.volume", F.col("v")), **of_pod, volume=F.col("v.name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Priorities of the journal.
_PRIORITIES = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
_PRIORITY_NUMBERS = (21, 21, 21, 17, 13, 9, 9, 5)


def journal(raw: DataFrame, units: list[str] = (), column: str = "value", max_bytes: int = 1 << 16) -> DataFrame:
    """Log records of exported journal entries, one JSON object a row; only of the given units, if any."""
    e = raw.select(F.from_json(column, "MESSAGE string, _SYSTEMD_UNIT string, SYSLOG_IDENTIFIER string, PRIORITY string, _PID string, _TRANSPORT string, __CURSOR string, __REALTIME_TIMESTAMP string").alias("e")).select("e.*")
    unit = F.coalesce("_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER")
    k = F.col("PRIORITY").try_cast("int")
    out = e.filter(unit.isin(list(units))) if units else e
    body = F.coalesce("MESSAGE", F.lit(""))
    attrs = F.create_map(F.lit("systemd.unit"), unit, F.lit("process.pid"), F.col("_PID"), F.lit("log.transport"), F.col("_TRANSPORT"), F.lit("log.original_length"), F.when(F.octet_length(body) > max_bytes, F.octet_length(body)).cast("string"))
    number = F.when(k.between(0, 7), F.get(F.array(*map(F.lit, _PRIORITY_NUMBERS)), k)).otherwise(0)
    return out.select(F.col("__REALTIME_TIMESTAMP").try_cast("long").alias("ts_us"), cut_utf8(body, max_bytes).alias("body"), F.when(k.between(0, 7), F.get(F.array(*map(F.lit, _PRIORITIES)), k)).otherwise("").alias("severity_text"), number.alias("severity_number"), maps.non_empty(attrs).alias("attrs"), maps.non_empty(F.create_map(F.lit("service.name"), F.regexp_replace(unit, r"\.service$", ""))).alias("resource"), F.col("__CURSOR").alias("cursor"))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_KVS = f"array<struct<key:string,value:{_VALUE}>>"


def _kv_map(c: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    pairs = F.coalesce(c, F.array().cast(_KVS))
    return F.map_filter(F.map_from_arrays(F.transform(pairs, lambda e: e["key"]), F.transform(pairs, lambda e: text(e["value"]))), lambda k, v: v.isNotNull())


def otlp_logs(raw: DataFrame, column: str = "value") -> DataFrame:
    """Log records of OTLP JSON export requests, one a row."""
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},attributes:{_KVS},traceId:string,spanId:string>"
    schema = f"resourceLogs array<struct<resource:struct<attributes:{_KVS}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<{record}>>>>>"
    r = raw.select(F.explode(F.from_json(column, schema)["resourceLogs"]).alias("r"))
    s = r.select(_kv_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    e = s.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("e"))
    return e.select("resource", "scope", F.col("e.timeUnixNano").cast("long").alias("ts_ns"), F.col("e.severityNumber").alias("severity_number"), F.col("e.severityText").alias("severity_text"), F.col("e.body.stringValue").alias("body"), _kv_map(F.col("e.attributes")).alias("attrs"), F.col("e.traceId").alias("trace_id"), F.col("e.spanId").alias("span_id"))


#: Span kinds and status codes by number.
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
CODES = ("UNSET", "OK", "ERROR")


def otlp_spans(raw: DataFrame, column: str = "value") -> DataFrame:
    """Spans of OTLP JSON export requests, one a row."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KVS},status:struct<code:int>>"
    schema = f"resourceSpans array<struct<resource:struct<attributes:{_KVS}>,scopeSpans:array<struct<spans:array<{span}>>>>>"
    r = raw.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r"))
    s = r.select(_kv_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    e = s.select("resource", F.explode("s.spans").alias("e"))
    named = lambda names, c: F.coalesce(F.get(F.array(*map(F.lit, names)), c), F.lit(names[0]))
    return e.select(
        F.col("e.traceId").alias("trace_id"), F.col("e.spanId").alias("span_id"), F.coalesce("e.parentSpanId", F.lit("")).alias("parent_span_id"), F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service"),
        F.col("e.name").alias("name"), named(KINDS, F.col("e.kind")).alias("kind"), named(CODES, F.col("e.status.code")).alias("status"), F.col("e.startTimeUnixNano").cast("long").alias("start_ns"), F.col("e.endTimeUnixNano").cast("long").alias("end_ns"), _kv_map(F.col("e.attributes")).alias("attrs"), "resource",
    )


#: Aggregation temporalities by number; exporters write the number or the name.
TEMPORALITIES = ("unspecified", "delta", "cumulative")

_POINT = f"attributes:{_KVS},startTimeUnixNano:string,timeUnixNano:string,flags:int"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
#: Members of each shape's data points beside _POINT.
_SHAPES = {
    "gauge": "asDouble:double,asInt:string",
    "sum": "asDouble:double,asInt:string",
    "histogram": "count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>",
    "exponentialHistogram": f"count:string,sum:double,min:double,max:double,scale:int,zeroCount:string,positive:{_SIDE},negative:{_SIDE}",
    "summary": "count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>",
}
#: Columns of a point besides what all have.
_POINT_COLUMNS = {
    "value": "double", "int_value": "long", "count": "long", "sum": "double", "min": "double", "max": "double", "bounds": "array<double>", "bucket_counts": "array<long>", "scale": "int",
    "zero_count": "long", "positive_offset": "int", "positive_counts": "array<long>", "negative_offset": "int", "negative_counts": "array<long>", "quantiles": "array<struct<q:double,v:double>>",
}


def otlp_points(raw: DataFrame, column: str = "value") -> DataFrame:
    """Data points of OTLP JSON export requests, one a row, in one shape for gauges, sums, histograms, exponential histograms and summaries.

    resource, scope, name, description, unit, type, is_monotonic, temporality, start_ns, ts_ns, no_value (the flag for a point without a recorded value), labels, and what
    the type has of value (also of whole numbers), int_value, count, sum, min, max, bounds, bucket_counts, scale, zero_count, positive and negative offsets and counts, and quantiles;
    the rest is null. A temporality that isn't known is unspecified. What isn't JSON, and metrics without points, give no rows.
    """
    shapes = ",".join(f"{n}:struct<aggregationTemporality:string,isMonotonic:boolean,dataPoints:array<struct<{_POINT},{m}>>>" for n, m in _SHAPES.items())
    schema = f"resourceMetrics array<struct<resource:struct<attributes:{_KVS}>,scopeMetrics:array<struct<scope:struct<name:string>,metrics:array<struct<name:string,description:string,unit:string,{shapes}>>>>>>"
    r = raw.select(F.explode(F.from_json(column, schema)["resourceMetrics"]).alias("r"))
    s = r.select(_kv_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s"))
    m = s.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.metrics").alias("m"))
    longs = lambda c: F.transform(c, lambda x: x.cast("long"))

    def points(shape: str) -> Column:
        own = F.col(f"m.{shape}")
        has = _SHAPES[shape]

        def one(p: Column) -> Column:
            given: dict[str, Column] = {}
            if "asInt" in has:
                given |= {"value": F.coalesce(p["asDouble"], p["asInt"].cast("double")), "int_value": p["asInt"].cast("long")}
            else:
                given |= {"count": p["count"].cast("long"), "sum": p["sum"]}
            if "min" in has:
                given |= {"min": p["min"], "max": p["max"]}
            if "explicitBounds" in has:
                given |= {"bounds": p["explicitBounds"], "bucket_counts": longs(p["bucketCounts"])}
            if "zeroCount" in has:
                given |= {"scale": p["scale"], "zero_count": F.coalesce(p["zeroCount"].cast("long"), F.lit(0).cast("long"))}
                for side in ("positive", "negative"):
                    given |= {f"{side}_offset": p[side]["offset"], f"{side}_counts": longs(p[side]["bucketCounts"])}
            if "quantile" in has:
                given["quantiles"] = F.transform(p["quantileValues"], lambda q: F.struct(q["quantile"].alias("q"), q["value"].alias("v")))
            named = own["aggregationTemporality"]
            temporality = F.when(named.isin("1", "AGGREGATION_TEMPORALITY_DELTA"), TEMPORALITIES[1]).when(named.isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), TEMPORALITIES[2]).otherwise(TEMPORALITIES[0])
            return F.struct(
                F.lit({"exponentialHistogram": "exponential"}.get(shape, shape)).alias("type"), F.coalesce(own["isMonotonic"], F.lit(False)).alias("is_monotonic"),
                (F.lit(TEMPORALITIES[0]) if shape in ("gauge", "summary") else temporality).alias("temporality"),
                p["startTimeUnixNano"].cast("long").alias("start_ns"), p["timeUnixNano"].cast("long").alias("ts_ns"),
                F.coalesce(p["flags"].bitwiseAND(1) == 1, F.lit(False)).alias("no_value"), _kv_map(p["attributes"]).alias("labels"),
                *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _POINT_COLUMNS.items()),
            )

        return F.transform(F.coalesce(own["dataPoints"], F.array().cast(f"array<struct<{_POINT},{has}>>")), one)

    every = F.concat(*(points(n) for n in _SHAPES))
    return m.select("resource", "scope", F.col("m.name").alias("name"), F.coalesce("m.description", F.lit("")).alias("description"), F.coalesce("m.unit", F.lit("")).alias("unit"), F.inline(every))
