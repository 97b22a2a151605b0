"""Scrape targets derived from pods and services.

pods: uid, name, namespace, ip, phase, terminating, host_network, annotations map, ports array<struct<name,port>>, labels map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import target_instance, target_url
from .kubernetes import pair_up, select_pods

SCRAPE, PORT, PATH, SCHEME = "prometheus.io/scrape", "prometheus.io/port", "prometheus.io/path", "prometheus.io/scheme"
MOST_TARGETS = 16


def reasons(pods: DataFrame) -> DataFrame:
    """pods with reasons: why they can't be scraped; none: they can."""
    return pods.withColumn("reasons", F.array_compact(F.array(F.when(F.coalesce("ip", F.lit("")) == "", "no address"), F.when(F.col("terminating"), "terminating"), F.when(F.col("phase").isin("Succeeded", "Failed"), F.concat(F.lit("phase "), F.col("phase"))))))


def scrapeable(pods: DataFrame) -> DataFrame:
    return reasons(pods).filter(F.size("reasons") == 0).drop("reasons")


def _path(annotations: Column) -> Column:
    raw = F.coalesce(F.nullif(annotations[PATH], F.lit("")), F.lit("/metrics"))
    return F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), raw))


def _url(ip: Column, port: Column, annotations: Column) -> Column:
    scheme = F.when(F.lower(annotations[SCHEME]) == "https", "https").otherwise("http")
    return target_url(scheme, ip, port, _path(annotations))


def _resolved(wanted: Column, ports: Column) -> Column:
    """Port numbers: a number stands for itself, a name for the first port of that name."""
    number = F.when(wanted.rlike(r"^\d{1,5}$"), wanted.cast("int"))
    named = F.try_element_at(F.filter(ports, lambda p: p["name"] == wanted), F.lit(1))["port"]
    return F.coalesce(number, named)


def pod_targets(pods: DataFrame) -> DataFrame:
    """(pod_uid, url, source, service): one for each port that the annotation lists, or each declared port where it lists none."""
    asked = scrapeable(pods).filter(F.coalesce(F.col("annotations")[SCRAPE] == "true", F.lit(False)))
    listed = F.transform(F.split(F.col("annotations")[PORT], ","), lambda t: F.trim(t))
    ports = F.when(F.coalesce(F.col("annotations")[PORT], F.lit("")) == "", F.transform("ports", lambda p: p["port"])).otherwise(F.transform(listed, lambda t: _resolved(t, F.col("ports"))))
    rows = asked.select(F.col("uid").alias("pod_uid"), "ip", "annotations", F.explode(F.array_distinct(F.array_compact(ports))).alias("port"))
    return rows.select("pod_uid", _url(F.col("ip"), F.col("port"), F.col("annotations")).alias("url"), F.lit("pod").alias("source"), F.lit(None).cast("string").alias("service")).distinct()


def service_targets(services: DataFrame, pods: DataFrame, selected: DataFrame) -> DataFrame:
    """Targets of the pods that annotated services select, at the service's target port (a number or a container port's name).

    services: uid, name, target_port, annotations; selected: service_uid, pod_uid.
    """
    s = services.filter(F.coalesce(F.col("annotations")[SCRAPE] == "true", F.lit(False))).select(F.col("uid").alias("service_uid"), F.col("name").alias("service"), "target_port", F.col("annotations").alias("_a"))
    p = scrapeable(pods).select(F.col("uid").alias("pod_uid"), "ip", "ports")
    rows = selected.join(s, "service_uid").join(p, "pod_uid").withColumn("port", _resolved(F.col("target_port"), F.col("ports"))).filter("port is not null")
    return rows.select("pod_uid", _url(F.col("ip"), F.col("port"), F.col("_a")).alias("url"), F.lit("service").alias("source"), "service")


def alike(services: DataFrame) -> DataFrame:
    """services with lead: the uid of the first, by name, of the services with equal namespace, selector, target_port and annotations.

    They select the same pods, at the same URLs, so what holds of the lead is known of all of them.
    """
    entries = lambda m: F.array_sort(F.map_entries(m))
    same = F.md5(F.to_json(F.struct("namespace", entries("selector").alias("s"), "target_port", entries("annotations").alias("a")), {"ignoreNullFields": "false"}))
    named = services.withColumn("_same", same)
    leads = named.groupBy("_same").agg(F.min_by("uid", F.struct(F.col("name").isNull(), "name", "uid")).alias("lead"))
    return named.join(leads, "_same").drop("_same")


def leading(services: DataFrame) -> DataFrame:
    """The services that lead those that are alike."""
    return services.filter("uid = lead").drop("lead")


def all_service_targets(services: DataFrame, pods: DataFrame) -> DataFrame:
    """service_targets() of all pods that services select: derived once for services that are alike, then paired up with each of their names."""
    grouped = alike(services)
    leads = leading(grouped).withColumn("name", F.col("uid"))
    found = service_targets(leads, pods, select_pods(leads, pods)).withColumnRenamed("service", "lead")
    return pair_up(grouped.select("lead", F.col("name").alias("service")), found, "lead").select("pod_uid", "url", "source", "service")


def monitor_targets(monitored: DataFrame, monitors: DataFrame, pods: DataFrame) -> DataFrame:
    """Targets of pods that monitors select (uid, monitor); monitors: monitor, port (number or name), path, scheme."""
    p = scrapeable(pods).select("uid", "ip", "ports")
    rows = monitored.join(monitors, "monitor").join(p, "uid").withColumn("_port", _resolved(F.col("port"), F.col("ports"))).filter("_port is not null")
    annotations = F.create_map(F.lit(PATH), F.coalesce("path", F.lit("")), F.lit(SCHEME), F.coalesce("scheme", F.lit("http")))
    return rows.select(F.col("uid").alias("pod_uid"), _url(F.col("ip"), F.col("_port"), annotations).alias("url"), F.lit("monitor").alias("source"), F.lit(None).cast("string").alias("service"), "monitor")


def dedupe_targets(targets: DataFrame, most: int | None = MOST_TARGETS) -> DataFrame:
    """One target for each pod and URL: a monitor before a pod's annotation before a service; a service's name is inherited.

    Of a pod's targets the first `most` by URL stay; beyond counts those that went, on every row of the pod. None: all stay.
    """
    order = F.when(F.col("source") == "monitor", 0).when(F.col("source") == "pod", 1).otherwise(2)
    one = targets.groupBy("pod_uid", "url").agg(F.min_by("source", order).alias("source"), F.min("service").alias("service"))
    if most is None:
        return one.withColumn("beyond", F.lit(0).cast("long"))
    w = Window.partitionBy("pod_uid")
    ranked = one.withColumn("_nth", F.row_number().over(w.orderBy("url"))).withColumn("beyond", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.filter(F.col("_nth") <= most).drop("_nth")


def merge_monitors(endpoints: DataFrame) -> DataFrame:
    """Monitors that share a pod and URL become one: interval_ms the finest, its timeout, rules of all (equal ones once), the one auth that agrees.

    endpoints: pod_uid, url, monitor, interval_ms (null: default), timeout_ms, rules array<string>, auth (null: none). Of conflicting auths
    that of the first monitor by name holds.
    """
    listed = F.array_sort(F.collect_list(F.struct("monitor", "rules", "auth")))
    out = endpoints.groupBy("pod_uid", "url").agg(listed.alias("l"), F.min("interval_ms").alias("interval_ms"), F.min_by("timeout_ms", F.when(F.col("interval_ms").isNotNull(), F.struct("interval_ms", "monitor"))).alias("timeout_ms"))
    rules = F.aggregate("l", F.array().cast("array<array<string>>"), lambda a, x: F.when(F.array_contains(a, x["rules"]), a).otherwise(F.concat(a, F.array(x["rules"]))))
    auth = F.try_element_at(F.filter("l", lambda x: x["auth"].isNotNull()), F.lit(1))["auth"]
    return out.select("pod_uid", "url", "interval_ms", "timeout_ms", F.flatten(rules).alias("rules"), auth.alias("auth"), F.transform("l", lambda x: x["monitor"]).alias("monitors"))


def identity_collisions(targets: DataFrame) -> DataFrame:
    """(namespace, service, instance, n, uids) of targets that nothing tells apart."""
    keyed = targets.withColumn("instance", target_instance("url"))
    return keyed.groupBy("namespace", "service", "instance").agg(F.count_distinct("pod_uid").alias("n"), F.array_sort(F.collect_set("pod_uid")).alias("uids")).filter("n > 1")


def explain(pods: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each pod: verdict, and its number of targets."""
    n = targets.groupBy("pod_uid").agg(F.count("*").alias("n_targets"))
    out = reasons(pods).join(n, F.col("uid") == F.col("pod_uid"), "left")
    note = F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")).when(F.coalesce("n_targets", F.lit(0)) > 0, "scraped").when(F.coalesce(F.col("annotations")[SCRAPE], F.lit("")) != "true", "not opted in").otherwise("no port")
    return out.select("uid", note.alias("note"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"))


#: Verdicts of explain_targets().
TARGET, DUPLICATE, CEILING, NO_PORT, BAD_PORT, EMPTY_LIST, NOT_OPTED_IN = "target", "the same target as another", "over the ceiling", "no such port", "not a port number", "nothing listed", "not opted in"


def _judged(wanted: Column, ports: Column) -> Column:
    """Struct entry, port, verdict (null: a candidate) of a port's number or name."""
    port = _resolved(wanted, ports)
    bad = F.when(wanted.rlike(r"^\d+$") & ~F.coalesce(port.between(1, 65535), F.lit(False)), BAD_PORT).when(port.isNull(), NO_PORT)
    return F.struct(wanted.alias("entry"), port.alias("port"), bad.alias("verdict"))


def _pod_entries(pods: DataFrame) -> DataFrame:
    """Each port that a pod's annotation lists, or that it declares where there is no annotation; one row without port for pods that have none or didn't opt in."""
    listed = F.filter(F.transform(F.split(F.col("annotations")[PORT], ","), lambda t: F.trim(t)), lambda t: t != "")
    declared = F.transform("ports", lambda p: F.struct(p["port"].cast("string").alias("entry"), p["port"].alias("port"), F.lit(None).cast("string").alias("verdict")))
    annotated = F.trim(F.coalesce(F.col("annotations")[PORT], F.lit(""))) != ""
    entries = F.when(annotated, F.transform(listed, lambda t: _judged(t, F.col("ports")))).otherwise(declared)
    none = lambda why: F.array(F.struct(F.lit("").alias("entry"), F.lit(None).cast("int").alias("port"), F.lit(why).alias("verdict")))
    said = F.when(~F.coalesce(F.col("annotations")[SCRAPE] == "true", F.lit(False)), none(NOT_OPTED_IN)).when(annotated & (F.size(listed) == 0), none(EMPTY_LIST)).when(F.size(entries) == 0, none(NO_PORT)).otherwise(entries)
    return pods.select(F.col("uid").alias("pod_uid"), F.lit("pod").alias("source"), F.lit("").alias("subject"), F.lit(None).cast("string").alias("subject_uid"), "ip", "_why", "annotations", F.posexplode(said).alias("pos", "e"))


def explain_targets(pods: DataFrame, services: DataFrame, selected: DataFrame, monitored: DataFrame, monitors: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(pod_uid, source, subject, subject_uid, entry, port, url, verdict): what became of every port entry of a pod, of every service that selects it, and of every monitor.

    verdict: target, or why it is none: the pod's own reasons, what is wrong with the entry, an earlier source with the same URL, or the ceiling of `most` targets a pod.
    The targets are those of dedupe_targets(): of one URL the monitor's before the pod's before a service's, then the first by subject and place. Every pod has a
    row at least, since it is asked for its own annotation. subject: the service's or monitor's name; subject_uid: a service's uid.
    """
    judged = reasons(pods).withColumn("_why", F.array_join("reasons", ", "))
    own = _pod_entries(judged)
    places = judged.select(F.col("uid").alias("pod_uid"), "ip", "ports", "_why")
    s = services.select(F.col("uid").alias("service_uid"), F.col("name").alias("subject"), "target_port", "annotations")
    in_ = F.coalesce(F.col("annotations")[SCRAPE] == "true", F.lit(False))
    refused = F.struct(F.col("target_port").alias("entry"), F.lit(None).cast("int").alias("port"), F.lit(NOT_OPTED_IN).alias("verdict"))
    of_services = selected.join(s, "service_uid").join(places, "pod_uid").select("pod_uid", F.lit("service").alias("source"), "subject", F.col("service_uid").alias("subject_uid"), "ip", "_why", "annotations", F.lit(0).alias("pos"), F.when(in_, _judged(F.col("target_port"), F.col("ports"))).otherwise(refused).alias("e"))
    marks = F.create_map(F.lit(PATH), F.coalesce("path", F.lit("")), F.lit(SCHEME), F.coalesce("scheme", F.lit("http")))
    watched = monitored.join(monitors, "monitor").join(places, F.col("uid") == F.col("pod_uid"))
    of_monitors = watched.select("pod_uid", F.lit("monitor").alias("source"), F.col("monitor").alias("subject"), F.lit(None).cast("string").alias("subject_uid"), "ip", "_why", marks.alias("annotations"), F.lit(0).alias("pos"), _judged(F.col("port"), F.col("ports")).alias("e"))
    rows = own.unionByName(of_services).unionByName(of_monitors)
    rows = rows.select("pod_uid", "source", "subject", "subject_uid", "pos", "e.entry", "e.port", F.coalesce("e.verdict", F.nullif("_why", F.lit(""))).alias("verdict"), F.when(F.col("e.port").isNotNull() & F.col("e.verdict").isNull(), _url(F.col("ip"), F.col("e.port"), F.col("annotations"))).alias("url"))
    # one exchange for both windows; with subject_uid among what they need it is the same one wherever these rows are read
    rows = rows.repartition("pod_uid")
    open_ = F.col("verdict").isNull()
    order = F.when(F.col("source") == "monitor", 0).when(F.col("source") == "pod", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("pod_uid", "url", open_).orderBy(order, "subject", "pos", "entry", "subject_uid"))
    ranked = rows.withColumn("_first", F.when(open_, first))
    nth = F.sum(F.when(F.col("_first") == 1, 1).otherwise(0)).over(Window.partitionBy("pod_uid").orderBy("url").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumn("_nth", nth)
    verdict = F.coalesce("verdict", F.when(F.col("_first") > 1, DUPLICATE).when(F.col("_nth") > most, CEILING).otherwise(TARGET))
    return ranked.select("pod_uid", "source", "subject", "subject_uid", "entry", "port", "url", verdict.alias("verdict"))


def explain_all_targets(pods: DataFrame, services: DataFrame, monitored: DataFrame, monitors: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """explain_targets() of all pods that services select: judged once for services that are alike. Where their lead is a candidate, the others come to the same URL after it."""
    grouped = alike(services)
    leads = leading(grouped)
    selected = select_pods(leads, pods)
    out = explain_targets(pods, leads, selected, monitored, monitors, most)
    later = F.when(F.col("verdict").isin(TARGET, CEILING), DUPLICATE).otherwise(F.col("verdict"))
    judged = out.filter("source = 'service'").withColumnRenamed("subject_uid", "lead").drop("subject").withColumn("_later", later)
    members = grouped.select("lead", F.col("name").alias("subject"), F.col("uid").alias("subject_uid"), (F.col("uid") == F.col("lead")).alias("_leads"))
    # a lead has a verdict for each pod that it selects
    counted = selected.groupBy(F.col("service_uid").alias("lead")).agg(F.count("*").alias("_r"))
    each = pair_up(members, judged, "lead", counted).withColumn("verdict", F.when(F.col("_leads"), F.col("verdict")).otherwise(F.col("_later")))
    return out.filter("source <> 'service'").unionByName(each.select(*out.columns))
