"""Cluster metadata: validity intervals, attribution of telemetry to pods, owners, services, monitors.

Lookup sides are joined by key and left to Catalyst and AQE, which broadcast a side only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.scalars import normalize_container_id

IDENTITY = ("k8s.pod.uid", "k8s.pod.name", "k8s.namespace.name", "container.id")
#: Owners that are followed one step further.
FOLLOWED = ("ReplicaSet", "Job")
#: Rows of one key that meet as one block, at least and at most, and blocks of a side that are few enough for smaller ones.
_BLOCK, _LARGE, _FEW = 512, 8192, 16


def validity(changes: DataFrame, key: list[str], ts: str, deleted: str) -> DataFrame:
    """Change feed to intervals: valid_from, valid_to (null: still valid) of each version of a key; deletions end the version before."""
    w = Window.partitionBy(*key).orderBy(ts)
    out = changes.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))
    return out.filter(~F.col(deleted)).drop(deleted)


def as_of(facts: DataFrame, intervals: DataFrame, key: str, ts: str, ttl: int = 0) -> DataFrame:
    """facts with the columns of the newest interval of their key that holds at their time, or ended no more than ttl before; none: nulls.

    The join is on the key alone with the time as a residual condition; the newest is picked by an aggregation over the fact's own
    digest, the same whenever a task runs again. Facts may repeat: equal ones are counted, looked up once and returned as often.
    """
    digest = F.md5(F.to_json(F.struct(*facts.columns), {"ignoreNullFields": "false"}))
    numbered = facts.withColumn("_row", digest).groupBy("_row").agg(*(F.first(c).alias(c) for c in facts.columns), F.count("*").alias("_n"))
    extra = [c for c in intervals.columns if c != key]
    right = intervals.select(F.col(key).alias("_key"), F.struct(*extra).alias("_v"))
    hit = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("_v.valid_from")) & (F.col("_v.valid_to").isNull() | (F.col(ts) < F.col("_v.valid_to") + ttl))
    own = [F.first(c).alias(c) for c in (*facts.columns, "_n")]
    met = numbered.join(right, hit, "left").groupBy("_row").agg(*own, F.max_by("_v", "_v.valid_from").alias("_v"))
    return met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*facts.columns, "_v.*")


def pod_ip_owners(pods: DataFrame) -> DataFrame:
    """(ip, uid) of the pod that an address belongs to: never host-network or finished pods; a live one before a terminating, then the latest claim, then uid."""
    own = pods.filter("ip <> '' and not host_network and phase not in ('Succeeded', 'Failed')")
    return own.groupBy("ip").agg(F.max_by("uid", _rank()).alias("uid"))


def _rank() -> Column:
    """Of several pods: a live one before a terminating, then the latest claim, then uid."""
    return F.struct(~F.col("terminating"), "claim_seq", "uid")


def _spread(key: str, *others: str) -> Column:
    """A join key in which nulls, which match nothing, are dealt over many values instead of one."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64(*others), F.lit(4096)).cast("string")))


def attribute_to_pods(rows: DataFrame, pods: DataFrame) -> DataFrame:
    """rows (container_id, namespace, pod, peer_ip) with pod_uid and how it was found: container, name, ip or none.

    A container id is looked up first, then the name in its namespace, then the address. Of several pods under one id or name
    (incarnations) a live one counts, then the latest.
    """
    normal = rows.withColumn("_cid", normalize_container_id("container_id")).withColumn("_cid", _spread("_cid", "pod", "peer_ip"))
    normal = normal.withColumn("namespace_key", _spread("namespace", "pod", "peer_ip")).withColumn("ip_key", _spread("peer_ip", "pod", "_cid"))
    by_container = pods.groupBy(F.col("container_id").alias("_cid")).agg(F.max_by("uid", _rank()).alias("_c"))
    by_name = pods.groupBy(F.col("namespace").alias("_ns"), F.col("name").alias("_pod")).agg(F.max_by("uid", _rank()).alias("_n"))
    by_ip = pod_ip_owners(pods).select(F.col("ip").alias("_ip"), F.col("uid").alias("_i"))
    out = normal.join(by_container, "_cid", "left")
    out = out.join(by_name, (F.col("namespace_key") == F.col("_ns")) & (F.col("pod") == F.col("_pod")), "left")
    out = out.join(by_ip, F.col("ip_key") == F.col("_ip"), "left")
    how = F.when(F.col("_c").isNotNull(), "container").when(F.col("_n").isNotNull(), "name").when(F.col("_i").isNotNull(), "ip").otherwise("none")
    return out.withColumn("pod_uid", F.coalesce("_c", "_n", "_i")).withColumn("found_by", how).drop("_cid", "namespace_key", "ip_key", "_c", "_ns", "_pod", "_n", "_ip", "_i")


def merge_resolved(rows: DataFrame, resolved: str = "resolved", identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """rows whose resource takes identity from what was resolved, and everything else only where the sender said nothing."""
    return rows.withColumn("resource", maps.identity_merged(F.col("resource"), F.col(resolved), identity))


def attribute_points(points: DataFrame, known: DataFrame, label: str, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """points (labels, resource) whose resource becomes that of the object that their own label names.

    known: id, attrs. A point about another object than its sender loses the sender's identity; an id that isn't known
    leaves only itself; a point without the label keeps its resource.
    """
    own = F.col("labels")[label]
    # points without the label are dealt by their numbers and their sender, since those of one sender may be most
    numbers = [c for c, t in points.dtypes if t in ("int", "bigint", "double", "timestamp")]
    keyed = points.withColumn("_id", own).withColumn("_sender", F.when(F.col("_id").isNull(), F.map_values("resource")))
    keyed = keyed.withColumn("_met", _spread("_id", "_sender", *numbers)).drop("_sender")
    out = keyed.join(known.select(F.col("id").alias("_known"), F.col("attrs").alias("_attrs")), F.col("_met") == F.col("_known"), "left").drop("_met")
    foreign = F.col("_id").isNotNull() & ~F.coalesce(F.col("resource")[label] == F.col("_id"), F.lit(False))
    found = maps.merged(maps.without(F.col("resource"), identity), F.col("_attrs"))
    alone = F.create_map(F.lit(label), F.col("_id"))
    resource = F.when(foreign & F.col("_attrs").isNotNull(), found).when(foreign, alone).when(F.col("_attrs").isNotNull(), maps.merged(F.col("resource"), F.col("_attrs"))).otherwise(F.col("resource"))
    return out.withColumns({"resource": resource, "foreign": foreign}).drop("_id", "_known", "_attrs")


def owner_chain(pods: DataFrame, objects: DataFrame) -> DataFrame:
    """(uid, owners): each pod's owners from its own, ReplicaSet and Job followed one step further, as kind/name.

    pods: uid, owner_refs array<struct<kind,name,uid>>; objects: kind, name, uid, owner_refs. A step needs the uid to agree.
    """
    first = pods.select("uid", F.posexplode("owner_refs").alias("pos", "o"))
    nexts = objects.select(F.col("uid").alias("_uid"), F.col("kind").alias("_kind"), F.col("owner_refs").alias("_refs"))
    joined = first.join(nexts, (F.col("o.uid") == F.col("_uid")) & (F.col("o.kind") == F.col("_kind")) & F.col("o.kind").isin(*FOLLOWED), "left")
    steps = F.concat(F.array(F.struct(F.col("pos"), F.lit(0).alias("depth"), F.col("o").alias("o"))), F.transform(F.coalesce("_refs", F.array().cast(pods.schema["owner_refs"].dataType)), lambda r: F.struct(F.col("pos"), F.lit(1).alias("depth"), r.alias("o"))))
    rows = joined.select("uid", F.inline(steps)).groupBy("uid", F.col("o.uid").alias("owner_uid")).agg(F.min(F.struct("pos", "depth", F.concat_ws("/", "o.kind", "o.name").alias("name"))).alias("s"))
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("l")).select("uid", F.transform("l", lambda x: x["name"]).alias("owners"))


def opted_in(services: DataFrame, monitored: DataFrame | None = None) -> DataFrame:
    """Services that carry the scrape annotation or that a monitor selects: the others never enter target derivation."""
    if monitored is None:
        return services.filter(F.coalesce(F.col("scrape_annotation") == "true", F.lit(False)))
    marked = services.join(monitored.select(F.col("service_uid").alias("uid")).distinct().withColumn("_m", F.lit(True)), "uid", "left")
    return marked.filter(F.coalesce(F.col("scrape_annotation") == "true", F.lit(False)) | F.coalesce("_m", F.lit(False))).drop("_m")


def _blocks(n: str) -> Column:
    """Blocks that n rows of a key are dealt over."""
    return F.ceil(F.col(n) / F.greatest(F.lit(_BLOCK), F.least(F.lit(_LARGE), F.ceil(F.col(n) / _FEW)))).alias(n)


def pair_up(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """The equi-join of both sides on key, also where few keys hold most rows of either side; columns: those of left, then those of right but the key.

    The rows of a key are dealt by hash over blocks; each block of left, as an array, meets each block of right in a partition of its own. A side has as many
    blocks as keep them at some _BLOCK rows, but no more than _FEW, unless blocks would hold more than _LARGE rows. So a row is shuffled _FEW times, and beyond
    that as often as the other side has _LARGE rows; no task holds more of a key than two blocks. counted: key and _r, the rows of right, where that is known
    more cheaply than by counting them.
    """
    own, others = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    counted = right.groupBy(key).agg(F.count("*").alias("_r")) if counted is None else counted
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(counted, key)
    blocks = sizes.select(key, _blocks("_l"), _blocks("_r"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    packed = left.join(blocks, key).withColumn("_i", F.pmod(F.xxhash64(*own), "_l")).groupBy(key, "_i", "_r").agg(F.collect_list(F.struct(*own)).alias("_own"))
    packed = packed.select(key, "_i", each("_r").alias("_j"), "_own")
    dealt = right.join(blocks, key).withColumn("_j", F.pmod(F.xxhash64(*others), "_r")).withColumn("_i", each("_l"))
    # a fixed number of partitions: they are small until the arrays are laid out, so they must not be put together by their size
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(n, key, "_i", "_j").join(packed, [key, "_i", "_j"])
    return met.select(key, *others, F.inline("_own")).select(*left.columns, *others)


def select_pods(services: DataFrame, pods: DataFrame) -> DataFrame:
    """(service_uid, pod_uid): pods in the service's namespace whose labels hold every pair of its selector; an empty selector selects none.

    services: uid, namespace, selector map; pods: uid, namespace, labels map. Each selector is tested once against each set of labels of its namespace that holds
    one of its pairs, not once for every service and pod that have them; services and pods are paired up at last.
    """
    entries = lambda m: F.array_sort(F.map_entries(m))
    named = lambda *c: F.md5(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}))
    s = services.filter(F.size("selector") > 0).select(F.col("uid").alias("service_uid"), F.col("namespace").alias("_ns"), entries("selector").alias("_want"))
    s = s.withColumn("_selector", named("_ns", "_want"))
    p = pods.select(F.col("uid").alias("pod_uid"), "namespace", entries("labels").alias("_have")).withColumn("_labels", named("namespace", "_have"))
    wants = s.groupBy("_selector").agg(F.first("_ns").alias("_ns"), F.first("_want").alias("_want"))
    haves = p.groupBy("_labels").agg(F.first("namespace").alias("namespace"), F.first("_have").alias("_have"), F.count("*").alias("_pods")).withColumn("_pair", F.explode("_have"))
    met = wants.join(haves, (F.col("_ns") == F.col("namespace")) & (F.col("_want")[0] == F.col("_pair")))
    holds = lambda e: F.exists("_have", lambda h: (h["key"] == e["key"]) & F.coalesce(h["value"] == e["value"], F.lit(False)))
    met = met.filter(F.forall("_want", holds)).select("_selector", "_labels", "_pods")
    fitting = p.select("pod_uid", "_labels").join(met.drop("_pods"), "_labels").select("_selector", "pod_uid")
    return pair_up(s.select("_selector", "service_uid"), fitting, "_selector", met.groupBy("_selector").agg(F.sum("_pods").alias("_r"))).select("service_uid", "pod_uid")


def selector_holds(labels: Column, match_labels: dict[str, str], expressions: list[tuple[str, str, list[str]]] = ()) -> Column:
    """Whether labels satisfy equality pairs and expressions (key, In | NotIn | Exists | DoesNotExist, values)."""
    out = F.lit(True)
    for k, v in match_labels.items():
        out = out & F.coalesce(labels[k] == v, F.lit(False))
    for key, op, values in expressions:
        has = F.map_contains_key(labels, key)
        among = has & F.coalesce(labels[key].isin(values), F.lit(False))
        out = out & {"In": among, "NotIn": ~among, "Exists": has, "DoesNotExist": ~has}[op]
    return out


def monitored(objects: DataFrame, monitors: list[dict]) -> DataFrame:
    """(uid, monitor) of the objects (uid, namespace, labels) that monitors select.

    A monitor: name, match_labels, expressions, and namespaces: None for any, else a list. All are tested in one pass.
    """
    hits = [F.when(selector_holds(F.col("labels"), m.get("match_labels", {}), m.get("expressions", [])) & (F.lit(True) if m.get("namespaces") is None else F.col("namespace").isin(m["namespaces"])), F.lit(m["name"])) for m in monitors]
    return objects.select("uid", F.explode(F.array_compact(F.array(*hits))).alias("monitor"))


def namespace_labels(rows: DataFrame, namespaces: DataFrame, prefix: str = "k8s.namespace.label.") -> DataFrame:
    """rows (resource, namespace) with the labels of their namespace in the resource, where it doesn't say otherwise."""
    own = namespaces.select(F.col("name").alias("_ns"), F.transform_keys("labels", lambda k, v: F.concat(F.lit(prefix), k)).alias("_l"))
    return rows.join(own, F.col("namespace") == F.col("_ns"), "left").withColumn("resource", maps.merged(F.col("_l"), F.col("resource"))).drop("_ns", "_l")
