"""Prometheus-style samples: filtering, relabelling, assembly into points.

Samples: scrape_id, name, family, role, labels map, value, ts_ms, pos (order within the scrape).
"""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from .logs import settled

#: A larger count isn't one.
_MAX_COUNT = float(1 << 63)


@dataclass(frozen=True)
class SeriesRule:
    """Keep or drop the series whose name, and labels, match; patterns are anchored, a missing label is empty."""

    action: str
    name: str = ".*"
    labels: tuple[tuple[str, str], ...] = ()

    def hit(self) -> Column:
        out = F.col("name").rlike(f"^(?:{self.name})$")
        for key, pattern in self.labels:
            out = out & F.coalesce(F.col("labels")[key], F.lit("")).rlike(f"^(?:{pattern})$")
        return out


def filter_series(samples: DataFrame, *rules: list[SeriesRule]) -> DataFrame:
    """Samples that every list of rules keeps; the first matching rule of a list decides, no match keeps."""
    for r in (r for one in rules for r in one):
        if r.action not in ("keep", "drop"):
            raise ValueError(f"unknown action: {r.action}")
    out = samples
    for one in rules:
        out = out.filter(F.coalesce(*(F.when(r.hit(), r.action == "keep") for r in one), F.lit(True)))
    return out


@dataclass(frozen=True)
class RelabelRule:
    action: str
    sources: tuple[str, ...]
    regex: str = "(.*)"


def relabel_keep_drop(samples: DataFrame, rules: list[RelabelRule]) -> DataFrame:
    """Samples that pass every rule: the joined source labels (`__name__`: the name) match a keep, and no drop."""
    out = F.lit(True)
    for r in rules:
        joined = F.concat_ws(";", *(F.coalesce(F.col("name") if s == "__name__" else F.col("labels")[s], F.lit("")) for s in r.sources))
        hit = joined.rlike(f"^(?:{r.regex or '(.*)'})$")
        out = out & (hit if r.action == "keep" else ~hit)
    return samples.filter(out)


def valid_count(value: Column) -> Column:
    return (value >= 0) & (value < _MAX_COUNT) & ~F.isnan(value)


def label_number(samples_label: Column) -> Column:
    """The number in an `le` or `quantile` label, infinities included; null if it is none."""
    text = F.lower(samples_label)
    return F.when(text.isin("+inf", "inf"), F.lit(float("inf"))).when(text == "-inf", F.lit(float("-inf"))).otherwise(samples_label.try_cast("double"))


def malformed(samples: DataFrame) -> DataFrame:
    """samples with malformed: counts that aren't counts, bounds or quantiles that aren't numbers (or lie outside 0 to 1)."""
    count = F.col("role").isin("histogram_bucket", "histogram_count", "summary_count")
    le, q = label_number(F.col("labels")["le"]), label_number(F.col("labels")["quantile"])
    bad = (count & ~valid_count(F.col("value"))) | ((F.col("role") == "histogram_bucket") & le.isNull()) | ((F.col("role") == "summary_quantile") & (q.isNull() | ~q.between(0, 1)))
    return samples.withColumn("malformed", F.coalesce(bad, F.lit(True)))


def point_ts(ts_ms: Column, scrape_ms: Column) -> Column:
    """The sample's own time if it has a sane one, else the scrape's, in nanoseconds."""
    return F.when((ts_ms > 0) & (ts_ms < 9_223_372_036_854), ts_ms * 1_000_000).otherwise(scrape_ms * 1_000_000)


def assemble_histograms(samples: DataFrame) -> DataFrame:
    """One point for each scrape, family and label set (without le): bounds, bucket_counts, count, sum.

    Buckets are sorted; of equal bounds the last counts; cumulative counts become differences that never fall and never pass the
    total. The total is the count sample, else the last bucket. The infinite bound isn't among the bounds.
    """
    ok = malformed(samples).filter("not malformed and role in ('histogram_bucket', 'histogram_sum', 'histogram_count')")
    key = maps.label_key(maps.without(F.col("labels"), ["le"]))
    bucket = F.when(F.col("role") == "histogram_bucket", F.struct(label_number(F.col("labels")["le"]).alias("le"), "pos", F.col("value").cast("long").alias("n")))
    one = ok.groupBy("scrape_id", "family", key.alias("labels")).agg(
        F.array_sort(F.collect_list(bucket)).alias("b"),
        F.max_by(F.when(F.col("role") == "histogram_sum", F.col("value")), F.when(F.col("role") == "histogram_sum", F.col("pos"))).alias("sum"),
        F.max_by(F.when(F.col("role") == "histogram_count", F.col("value")), F.when(F.col("role") == "histogram_count", F.col("pos"))).cast("long").alias("n"),
        F.max("ts_ms").alias("ts_ms"),
    )
    last = F.filter("b", lambda x, k: (k == F.size("b") - 1) | (x["le"] != F.get("b", k + 1)["le"]))
    one = one.withColumn("b", last).withColumn("count", F.coalesce("n", F.element_at("b", -1)["n"], F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    step = F.aggregate("b", F.struct(zero.alias("seen"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct(F.least(F.greatest(a["seen"], x["n"]), F.col("count")).alias("seen"), F.concat(a["out"], F.array(F.greatest(F.least(F.greatest(a["seen"], x["n"]), F.col("count")) - a["seen"], zero))).alias("out")))
    finite = F.filter("b", lambda x: x["le"] < float("inf"))
    one = one.withColumn("_s", step).withColumn("bounds", F.transform(finite, lambda x: x["le"]))
    head = F.slice(F.col("_s.out"), F.lit(1), F.size("bounds"))
    rest = F.col("count") - F.aggregate(head, zero, lambda a, x: a + x)
    return one.select("scrape_id", "family", "labels", "bounds", F.concat(head, F.array(rest)).alias("bucket_counts"), "count", "sum", "ts_ms")


def assemble_summaries(samples: DataFrame) -> DataFrame:
    """One point for each scrape, family and label set (without quantile): quantiles sorted (q, v), count, sum. Of equal quantiles the last counts."""
    ok = malformed(samples).filter("not malformed and role in ('summary_quantile', 'summary_sum', 'summary_count')")
    key = maps.label_key(maps.without(F.col("labels"), ["quantile"]))
    q = F.when(F.col("role") == "summary_quantile", F.struct(label_number(F.col("labels")["quantile"]).alias("q"), "pos", F.col("value").alias("v")))
    pick = lambda role: F.max_by(F.when(F.col("role") == role, F.col("value")), F.when(F.col("role") == role, F.col("pos")))
    one = ok.groupBy("scrape_id", "family", key.alias("labels")).agg(F.array_sort(F.collect_list(q)).alias("b"), pick("summary_sum").alias("sum"), pick("summary_count").cast("long").alias("count"))
    last = F.filter("b", lambda x, k: (k == F.size("b") - 1) | (x["q"] != F.get("b", k + 1)["q"]))
    return one.select("scrape_id", "family", "labels", F.transform(last, lambda x: F.struct(x["q"].alias("q"), x["v"].alias("v"))).alias("quantiles"), F.coalesce("count", F.lit(0)).alias("count"), "sum")


def number_points(samples: DataFrame) -> DataFrame:
    """Counters as monotonic sums, everything else as gauges; `collision` marks samples whose name had another shape first in the scrape."""
    shape = F.when(F.col("role") == "counter", "sum").when(F.col("role").startswith("histogram"), "histogram").when(F.col("role").startswith("summary"), "summary").otherwise("gauge")
    w = Window.partitionBy("scrape_id", "name").orderBy("pos")
    out = samples.withColumn("type", shape).withColumn("collision", F.col("type") != F.first("type").over(w))
    return out.filter("type in ('sum', 'gauge')").withColumn("is_monotonic", F.col("type") == "sum")


def exemplar_points(samples: DataFrame, most: int = 16) -> DataFrame:
    """(scrape_id, name, exemplars): up to `most` a name, in order, ids taken out of their labels."""
    own = F.struct("pos", F.col("exemplar.value").alias("value"), F.col("exemplar.labels")["trace_id"].alias("trace_id"), F.col("exemplar.labels")["span_id"].alias("span_id"), maps.without(F.col("exemplar.labels"), ["trace_id", "span_id"]).alias("attrs"))
    w = Window.partitionBy("scrape_id", "name").orderBy("pos")
    few = samples.filter("exemplar is not null").withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most)
    listed = few.withColumn("_e", own).groupBy("scrape_id", "name").agg(F.collect_list(F.struct(F.col("_e.pos").alias("pos"), F.to_json("_e").alias("e"))).alias("l"))
    return listed.select("scrape_id", "name", F.transform(F.array_sort("l"), lambda x: x["e"]).alias("exemplars"))


def native_to_exponential(points: DataFrame) -> DataFrame:
    """points (schema, spans array<struct<offset,length>>, deltas array<bigint>, count) with dense buckets: scale, offset, counts.

    Deltas are differences of adjacent counts; gaps between spans are empty buckets. Schemas outside -4..8 are refused (null).
    """
    zero = F.lit(0).cast("long")
    running = F.aggregate("deltas", F.struct(zero.alias("n"), F.array().cast("array<bigint>").alias("out")), lambda a, d: F.struct((a["n"] + d).alias("n"), F.concat(a["out"], F.array(a["n"] + d)).alias("out")))["out"]
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("out"), F.lit(True).alias("first"))

    def add(a: Column, s: Column) -> Column:
        gap = F.when(a["first"] | (s["offset"] <= 0), F.array().cast("array<bigint>")).otherwise(F.array_repeat(zero, s["offset"]))
        return F.struct((a["used"] + s["length"]).alias("used"), F.concat(a["out"], gap, F.slice(F.col("_n"), a["used"] + 1, s["length"])).alias("out"), F.lit(False).alias("first"))

    out = points.withColumn("_n", running).withColumn("_d", F.aggregate("spans", start, add)["out"])
    good = F.col("schema").between(-4, 8)
    total = F.aggregate("_d", zero, lambda a, x: a + x)
    return out.withColumns({"scale": F.when(good, F.col("schema")), "offset": F.when(good, F.get("spans", F.lit(0))["offset"] - 1), "counts": F.when(good, F.col("_d")), "count": F.greatest("count", total)}).drop("_n", "_d")


@dataclass(frozen=True)
class Splitter:
    """Series of a family that describe other objects: which labels become whose attributes."""

    family: str
    group_by: tuple[tuple[str, str], ...]
    drop_labels: str = ""
    datapoint: tuple[str, ...] = ("k8s.node.name",)


def _without_like(labels: Column, pattern: str) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.rlike(f"^(?:{pattern})$"))


def split_by_object(samples: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """samples with `resource` of the object that a series names, and what is left in labels; others keep an empty resource.

    The first splitter whose family pattern matches counts. Of several labels for one attribute the last that isn't empty wins.
    Attributes in `datapoint` stay on the point.
    """
    resource, left = maps.empty(), F.col("labels")
    for s in reversed(splitters):
        hit = F.col("family").rlike(f"^(?:{s.family})$")
        names = list(dict.fromkeys(a for _, a in s.group_by))
        value = lambda a, s=s: F.coalesce(*(F.nullif(F.col("labels")[k], F.lit("")) for k, x in reversed(s.group_by) if x == a))
        own = F.map_filter(F.create_map(*(x for a in names if a not in s.datapoint for x in (F.lit(a), value(a)))), lambda k, v: v.isNotNull()) if set(names) - set(s.datapoint) else maps.empty()
        back = F.map_filter(F.create_map(*(x for a in names if a in s.datapoint for x in (F.lit(a), value(a)))), lambda k, v: v.isNotNull()) if set(names) & set(s.datapoint) else maps.empty()
        rest = maps.without(F.col("labels"), [k for k, _ in s.group_by])
        if s.drop_labels:
            rest = _without_like(rest, s.drop_labels)
        resource, left = F.when(hit, own).otherwise(resource), F.when(hit, maps.merged(rest, back)).otherwise(left)
    return samples.withColumn("_left", left).withColumn("resource", resource).withColumn("labels", F.col("_left")).drop("_left")


def drop_rollups(samples: DataFrame) -> DataFrame:
    """Samples of containers, and of pods for network families only: rows that sum up others go."""
    label = lambda k: F.coalesce(F.col("labels")[k], F.lit(""))
    of_pod, of_container = label("pod") != "", label("container") != ""
    return samples.filter(of_pod & (of_container | F.col("name").startswith("container_network_") | ~F.col("name").startswith("container_")))


def scrape_health(scrapes: DataFrame) -> DataFrame:
    """(target, name, value) of scrapes (target, ok, seconds, samples)."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in (("up", F.col("ok").cast("int")), ("scrape_duration_seconds", F.col("seconds")), ("scrape_samples_scraped", F.col("samples")))))
    return scrapes.select("target", F.inline(rows))


def target_status(targets: DataFrame, scrapes: DataFrame) -> DataFrame:
    """The last outcome of each target: down, pending (never scraped), up; the failures first."""
    last = scrapes.groupBy("target").agg(F.max_by("ok", "scraped").alias("ok"), F.max("scraped").alias("scraped"))
    out = targets.join(last, "target", "left")
    state = F.when(F.col("ok").isNull(), "pending").when(F.col("ok"), "up").otherwise("down")
    return out.select("target", state.alias("state"), "scraped").orderBy(F.col("state") != "down", F.col("state") != "pending", "target")


def cap_samples(samples: DataFrame, most: int) -> DataFrame:
    """The first `most` samples of each scrape, with failed where there were more."""
    w = Window.partitionBy("scrape_id")
    out = samples.withColumn("_nth", F.row_number().over(w.orderBy("pos"))).withColumn("failed", F.count("*").over(w) > most)
    return out.filter(F.col("_nth") <= most).drop("_nth")


def counter_delta(points: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """points with delta: the increase since the point before; after a fall the whole new value; none for the first."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    return points.withColumn("delta", F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)))


_SERIES = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*(?:#\s*\{(.*)\}\s+(\S+).*)?$"
_LABEL = r'([A-Za-z_]\w*)="([^"\\]*(?:\\.[^"\\]*)*)"'


def _labels(text: Column) -> Column:
    keys = F.regexp_extract_all(text, F.lit(_LABEL), F.lit(1))
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r'\\(["\\])', "$1")
    values = F.transform(F.regexp_extract_all(text, F.lit(_LABEL), F.lit(2)), lambda v: F.when(v.contains("\\"), plain(v)).otherwise(v))
    return F.when(text.isNull() | (text == ""), maps.empty()).otherwise(F.map_from_arrays(keys, values))


def _declared(whole: DataFrame) -> DataFrame:
    """whole (lines: a body's) with types: a map of family to type from its `# TYPE` lines; of several for one family the first counts."""
    said = F.transform(F.filter("lines", lambda x: x.startswith("#") & x.rlike(r"^#\s*TYPE\s+\S")), lambda x: F.struct(F.regexp_extract(x, r"^#\s*TYPE\s+(\S+)", 1).alias("family"), F.regexp_extract(x, r"(\S+)$", 1).alias("type")))
    # step by step, since what stands in a lambda is computed for every element
    out = settled(whole.withColumn("_said", said))
    out = settled(out.withColumns({"_all": F.col("_said.family"), "_own": F.array_distinct("_said.family")}))
    types = F.map_from_arrays("_own", F.transform("_own", lambda f: F.get("_said", F.array_position("_all", f).cast("int") - 1)["type"]))
    return settled(out.select(*whole.columns, types.alias("types")))


def parse_exposition(bodies: DataFrame) -> DataFrame:
    """Samples of scrape bodies (scrape_id, body): types are declared by `# TYPE` lines and looked up by the series' family, each body by itself.

    Lines that aren't series are marked malformed and keep their text in name. There is no shuffle: a body's types are a map beside its lines.
    """
    whole = bodies.select("scrape_id", F.transform(F.split("body", "\n"), lambda x: F.trim(x)).alias("lines"))
    series = _declared(whole).select("scrape_id", "types", F.posexplode("lines").alias("pos", "line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    # one match gives all parts: no line holds a line feed, so they are cut apart at it
    cut = F.split(F.regexp_replace("line", _SERIES, "$1\n$2\n$3\n$4\n$5\n$6\n"), "\n")
    read = settled(series.withColumn("_part", cut))
    part = lambda k: F.get("_part", F.lit(k - 1))
    good = F.size("_part") > 1
    out = read.select("scrape_id", "pos", "types", part(1).alias("name"), part(3).try_cast("double").alias("value"), F.when(good, _labels(part(2))).alias("labels"), F.nullif(part(4), F.lit("")).try_cast("long").alias("ts_ms"), F.nullif(part(6), F.lit("")).alias("exemplar_value"), F.nullif(part(5), F.lit("")).alias("exemplar_labels"))
    # the family is the name, or the name without a suffix that the declared type allows
    suffixes = {"": ("counter", "gauge", "untyped", "unknown", "summary", "histogram"), "_total": ("counter",), "_bucket": ("histogram",), "_sum": ("histogram", "summary"), "_count": ("histogram", "summary")}

    def tried(suffix: str, allowed: tuple[str, ...]) -> Column:
        family = F.substring("name", 1, F.length("name") - len(suffix))
        own = F.col("types")[family]
        return F.when(F.col("name").endswith(suffix) & own.isin(*allowed), F.struct(family.alias("family"), own.alias("type"), F.lit(suffix).alias("suffix")))

    found = out.withColumn("t", F.coalesce(*(tried(s, ts) for s, ts in suffixes.items()))).drop("types")
    role = (
        F.when(F.col("t").isNull() | F.col("t.type").isin("gauge", "untyped", "unknown"), "gauge").when(F.col("t.type") == "counter", "counter")
        .when(F.col("t.suffix") != "", F.concat(F.col("t.type"), F.col("t.suffix"))).when(F.col("t.type") == "summary", "summary_quantile").otherwise("gauge")
    )
    exemplar = F.when(F.col("exemplar_value").isNotNull(), F.struct(F.col("exemplar_value").try_cast("double").alias("value"), _labels(F.col("exemplar_labels")).alias("labels")))
    return found.select("scrape_id", "pos", "name", F.coalesce("t.family", "name").alias("family"), role.alias("role"), "labels", "value", F.coalesce("ts_ms", F.lit(0)).alias("ts_ms"), exemplar.alias("exemplar"), F.col("value").isNull().alias("malformed"))
