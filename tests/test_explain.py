"""What became of every port, service and monitor."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from obslake.operators import kubernetes as k8s
from obslake.operators import targets as tg
from obslake.plans import cluster_queries as q

SF = "/root/testdata/sf0.001"
PODS = "uid string, name string, namespace string, ip string, phase string, terminating boolean, host_network boolean, annotations map<string,string>, ports array<struct<name:string,port:int>>, labels map<string,string>"


def test_targets_among_the_verdicts_are_the_targets(spark):
    pods, services = q._pods(spark, SF), q._services(spark, SF)
    out = tg.explain_targets(pods, services, k8s.select_pods(services, pods), k8s.monitored(pods, q._MONITORS), q._monitor_table(spark), 2).cache()
    want = {(r.pod_uid, r.url) for r in q.scrape_targets(spark, SF).collect()}
    assert {(r.pod_uid, r.url) for r in out.filter("verdict = 'target'").collect()} == want and out.filter("verdict = 'target'").count() == len(want)
    assert out.select("pod_uid").distinct().count() == pods.count()
    beyond = {r.pod_uid: r.beyond for r in q.scrape_targets(spark, SF).collect()}
    over = Counter(r.pod_uid for r in out.filter(F.col("verdict") == tg.CEILING).collect())
    assert {u: n for u, n in beyond.items() if n} == dict(over)


def test_entries(spark):
    ports = [("http", 80), ("http", 81), (None, 9000)]
    notes = {tg.SCRAPE: "true"}
    pods = [("listed", notes | {tg.PORT: "http, 0,70000,nope,80,9000"}), ("blank", notes | {tg.PORT: " , ,"}), ("declared", notes), ("out", {}), ("bare", notes), ("gone", notes)]
    frame = spark.createDataFrame([(u, u, "ns", "" if u == "gone" else "1.2.3.4", "Running", False, False, a, [] if u == "bare" else ports, {}) for u, a in pods], PODS)
    none = spark.createDataFrame([], "uid string, monitor string"), spark.createDataFrame([], "monitor string, port string, path string, scheme string")
    services = spark.createDataFrame([("s", "svc", "http", {}), ("t", "other", "9000", notes)], "uid string, name string, target_port string, annotations map<string,string>")
    chosen = spark.createDataFrame([("s", "listed"), ("t", "declared")], "service_uid string, pod_uid string")
    got = sorted(((r.pod_uid, r.source, r.entry, r.port, r.verdict) for r in tg.explain_targets(frame, services, chosen, *none).collect()), key=lambda r: (r[0], r[1], r[2], r[3] or 0))
    want = [("bare", "pod", "", None, tg.NO_PORT), ("blank", "pod", "", None, tg.EMPTY_LIST), ("out", "pod", "", None, tg.NOT_OPTED_IN)]
    want += [("declared", "pod", str(p), p, tg.TARGET) for _, p in ports] + [("declared", "service", "9000", 9000, tg.DUPLICATE)]
    want += [("gone", "pod", str(p), p, "no address") for _, p in ports]
    want += [("listed", "pod", "http", 80, tg.TARGET), ("listed", "pod", "0", 0, tg.BAD_PORT), ("listed", "pod", "70000", 70000, tg.BAD_PORT), ("listed", "pod", "nope", None, tg.NO_PORT), ("listed", "pod", "80", 80, tg.DUPLICATE), ("listed", "pod", "9000", 9000, tg.TARGET), ("listed", "service", "http", None, tg.NOT_OPTED_IN)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3] or 0))
    assert tg.explain_targets(frame.limit(0), services, chosen, *none).count() == 0
