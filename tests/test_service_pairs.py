"""Services and pods in large groups: the pairs are all there, and no task makes most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from obslake.operators import kubernetes as k8s
from obslake.operators import targets as tg


def _cluster(spark, n_services, n_pods):
    """One namespace and one label, in one partition each, as in a small file."""
    label = F.create_map(F.lit("app"), F.lit("web"))
    services = spark.range(n_services).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("uid"), F.lit("ns").alias("namespace"), label.alias("selector")).coalesce(1)
    pods = spark.range(n_pods).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("uid"), F.lit("ns").alias("namespace"), label.alias("labels")).coalesce(1)
    return services, pods


def _largest_share(out):
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes), sum(sizes)


def test_pairs_of_one_selector_are_dealt_over_tasks(spark):
    services, pods = _cluster(spark, 1500, 2000)
    out = k8s.select_pods(services, pods)
    share, n = _largest_share(out)
    assert n == 3_000_000 and out.distinct().count() == n and share < 0.7


def test_rows_are_shuffled_a_few_times_only(spark):
    """Once for each block of the other side: 16 blocks until they would be too large to hold, not one more for every 512 rows."""
    sizes = spark.createDataFrame([(n,) for n in (1, 512, 513, 5_000, 30_000, 130_000, 270_000)], "n long")
    assert [r.n for r in sizes.select(k8s._blocks("n")).collect()] == [1, 1, 2, 10, 16, 16, 33]
    services, pods = _cluster(spark, 40_000, 700)
    out = k8s.select_pods(services, pods)
    assert out.count() == 28_000_000
    counted = k8s.pair_up(services.select(F.lit("k").alias("key"), "uid"), pods.select(F.lit("k").alias("key"), F.col("uid").alias("pod")), "key")
    assert counted.count() == 28_000_000


def test_selectors_against_labels(spark):
    services = spark.createDataFrame([("a", "n", {"x": "1"}), ("a2", "n", {"x": "1"}), ("b", "n", {"x": "1", "y": "2"}), ("c", "n", {}), ("d", None, {"x": "1"}), ("e", "n", {"x": None}), ("f", "m", {"x": "1"}), ("g", "n", None)], "uid string, namespace string, selector map<string,string>")
    pods = spark.createDataFrame([("p", "n", {"x": "1"}), ("q", "n", {"y": "2", "x": "1"}), ("r", "n", {"x": None}), ("s", None, {"x": "1"}), ("t", "n", None), ("q", "n", {"x": "1"})], "uid string, namespace string, labels map<string,string>")
    got = sorted(tuple(r) for r in k8s.select_pods(services, pods).collect())
    assert got == sorted([(s, p) for s in ("a", "a2") for p in ("p", "q", "q")] + [("b", "q")])


PODS = "uid string, name string, namespace string, ip string, phase string, terminating boolean, host_network boolean, annotations map<string,string>, ports array<struct<name:string,port:int>>, labels map<string,string>"
SERVICES = "uid string, name string, namespace string, target_port string, annotations map<string,string>, selector map<string,string>"


def _many(spark, n_services, n_pods):
    yes = {tg.SCRAPE: "true"}
    pods = [(f"p{i:04}", f"p{i:04}", "ns", f"1.1.{i // 200}.{i % 200}", "Running", i % 5 == 4, False, yes if i % 3 == 0 else {}, [("http", 80), ("metrics", 9100)], {"app": "web"}) for i in range(n_pods)]
    services = [(f"u{i:04}", f"s{(i * 7) % n_services:04}", "ns", ("http", "9100", "gone")[i % 3], yes if i % 2 == 0 else {}, {"app": "web"}) for i in range(n_services)]
    return spark.createDataFrame(services, SERVICES).coalesce(1), spark.createDataFrame(pods, PODS).coalesce(1)


def test_targets_of_services_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(k8s, "_BLOCK", 50)
    services, pods = _many(spark, 1200, 700)
    share, n = _largest_share(tg.all_service_targets(services, pods))
    assert n == 2 * 200 * 560 and share < 0.7
    services, pods = _many(spark, 24, 30)
    want = tg.service_targets(services, pods, k8s.select_pods(services, pods))
    got = tg.all_service_targets(services, pods)
    assert want.columns == got.columns and sorted(map(tuple, got.drop("source").collect())) == sorted(map(tuple, want.drop("source").collect()))


def test_leads_give_the_targets_of_all(spark):
    services, pods = _many(spark, 24, 30)
    leads = tg.leading(tg.alike(services))
    assert leads.count() == 6
    one = lambda s: sorted(map(tuple, tg.dedupe_targets(tg.service_targets(s, pods, k8s.select_pods(s, pods))).collect()))
    assert one(leads) == one(services) != []


def test_verdicts_of_services_that_are_alike(spark):
    services, pods = _many(spark, 24, 30)
    watched, monitors = pods.select("uid", F.lit("m").alias("monitor")).filter("uid < 'p0006'"), spark.createDataFrame([("m", "http", "", "http")], "monitor string, port string, path string, scheme string")
    for most in (1, 16):
        want = tg.explain_targets(pods, services, k8s.select_pods(services, pods), watched, monitors, most)
        got = tg.explain_all_targets(pods, services, watched, monitors, most)
        plain = lambda d: sorted(tuple(map(str, r)) for r in d.select(*want.columns).collect())
        assert plain(got) == plain(want)


def test_services_of_one_name_are_told_apart_by_uid(spark):
    pods = spark.createDataFrame([("p", "p", "ns", "1.1.1.1", "Running", False, False, {}, [("http", 80)], {"app": "web"})], PODS)
    services = spark.createDataFrame([(u, "same", "ns", port, {tg.SCRAPE: "true"}, {"app": "web"}) for u, port in (("c", "80"), ("a", "http"), ("b", "80"))], SERVICES)
    none, monitors = pods.select("uid", F.lit("m").alias("monitor")).limit(0), spark.createDataFrame([("m", "http", "", "http")], "monitor string, port string, path string, scheme string")
    out = tg.explain_targets(pods, services.withColumn("target_port", F.lit("80")), k8s.select_pods(services, pods), none, monitors)
    assert {r.subject_uid: r.verdict for r in out.filter("source = 'service'").collect()} == {"a": tg.TARGET, "b": tg.DUPLICATE, "c": tg.DUPLICATE}
    plan = out._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("Union")]
    assert before.count("Window") == 2 and before.count("Exchange") == 1, "both windows read one exchange"


def test_points_without_the_label_are_dealt(spark):
    """They match nothing, so they needn't meet in one task."""
    points = spark.range(4000).select("id", F.create_map(F.lit("other"), F.lit("x")).alias("labels"), F.create_map(F.lit("k8s.pod.name"), F.lit("p")).alias("resource"))
    known = spark.createDataFrame([("c", {"k8s.pod.name": "known"})], "id string, attrs map<string,string>")
    mine = spark.range(1).select((F.col("id") - 1).alias("id"), F.create_map(F.lit("container.id"), F.lit("c")).alias("labels"), F.create_map(F.lit("k8s.pod.name"), F.lit("p")).alias("resource"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = k8s.attribute_points(points.unionByName(mine), known, "container.id")
        got = out.select("id", "foreign", F.col("resource")["k8s.pod.name"].alias("pod"), F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {(r.foreign, r.pod) for r in got if r.id >= 0} == {(False, "p")} and [(r.foreign, r.pod) for r in got if r.id < 0] == [(True, "known")]
    assert len(got) == 4001 and len({r.part for r in got if r.id >= 0}) == 4
