"""Resources, empty metrics, hooked targets, line times, rates of policies, chunks, attribution: small literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from obslake.operators import kubernetes, logs, resources, sampling
from obslake.operators.resources import ResourceConfig
from obslake.operators.trace_chain import TraceChain, batch_writer
from obslake.sources import writers


def test_layers_of_a_resource(spark):
    rows = spark.createDataFrame([("n1", "ns", "p", "u1", "", {"team": "x", "service.name": "sent"}), (None, None, None, None, "cid", {"service.instance.id": "own"})], "node string, namespace string, pod string, pod_uid string, container_id string, resource map<string,string>")
    got = [r.resource for r in resources.build_resource(rows, ResourceConfig(static={"k8s.pod.name": "fixed"}, templates={"zone": "upper(node)"}, instance_prefix="c/", enable=("k8s.*", "service.*", "zone"), disable=("k8s.node.name",))).collect()]
    assert got[0] == {"service.name": "sent", "k8s.namespace.name": "ns", "k8s.pod.name": "fixed", "k8s.pod.uid": "u1", "zone": "N1", "service.namespace": "ns", "service.instance.id": "c/u1"}
    assert got[1] == {"k8s.pod.name": "fixed", "service.instance.id": "c/own"}
    assert resources.build_resource(rows.limit(0)).columns == rows.columns
    with pytest.raises(Exception):
        ResourceConfig(enable=("(",))


def test_empty_metrics_go_with_their_scopes(spark):
    rows = spark.createDataFrame([(1, [("a", [1.0]), ("b", []), ("c", None)]), (2, [("d", [])]), (3, [])], "id int, metrics array<struct<name:string,points:array<double>>>")
    got = resources.drop_empty_metrics(rows).collect()
    assert [(r.id, r.dropped, [m.name for m in r.metrics]) for r in got] == [(1, 2, ["a"])]
    assert rows.agg(resources.empty_metrics(rows).alias("n")).first().n == 3


def test_hooks_drop_and_rewrite_targets(spark):
    rows = spark.createDataFrame([("http://1.2.3.4:80/metrics", "a"), ("http://[fe80::1]:80/x/y", "b"), ("http://h:1/z", "c")], "url string, uid string")
    got = resources.hooked_targets(rows, F.when(F.col("uid") == "c", False), F.when(F.col("uid") == "b", "new")).collect()
    assert [r.url for r in got] == ["http://1.2.3.4:80/metrics", "http://[fe80::1]:80/new"]


def test_hooks_see_every_target(spark):
    """No ceiling of targets a pod comes before them."""
    from obslake.operators import targets
    from obslake.plans import cluster_queries, resource_queries

    offered = spark.range(40).select(F.lit("p").alias("pod_uid"), F.concat(F.lit("http://1.1.1.1:"), (F.col("id") % 30).cast("string"), F.lit("/m")).alias("url"), F.lit("pod").alias("source"), F.lit(None).cast("string").alias("service"))
    assert targets.dedupe_targets(offered, None).count() == 30 and targets.dedupe_targets(offered).count() == 16
    sf = "/root/testdata/sf0.001"
    hooked = {r.url: r.n for r in resource_queries.hooked_targets(spark, sf).collect()}
    kept = {r.pod_uid: r.beyond for r in cluster_queries.scrape_targets(spark, sf).collect()}
    every = cluster_queries._targets(spark, sf, None)
    assert sum(kept.values()) > 0 and every.count() == cluster_queries.scrape_targets(spark, sf).count() + sum(kept.values())
    assert sum(hooked.values()) == every.filter("not contains(url, '/custom')").count()


LOG = "body string, attrs map<string,string>, resource map<string,string>, severity_text string, severity_number int, ts_us long"


def test_line_times(spark):
    lines = ['{"time":"2026-01-02T03:04:05Z","level":"warn"}', '{"ts":"2026-01-02T03:04:05+01:00"}', 'time="2026-01-02 03:04:05" level=info', '{"time":"noon"}', "plain", '{"level":"x","level":"y"']
    rows = spark.createDataFrame([(x, {}, {}, None, None, t) for x in lines for t in (None, 7)], LOG)
    at = 1_767_323_045_000_000
    got = [(r.ts_us, r.time_rejected) for r in logs.enrich_lines(rows, overwrite=True).collect()]
    assert got == [(at, False), (at, False), (at - 3_600_000_000, False), (at - 3_600_000_000, False), (at, False), (7, True), (None, False), (7, False), (None, False), (7, False), (None, False), (7, False)]
    assert [r.ts_us for r in logs.enrich_lines(rows).collect()][:2] == [at, 7]


@pytest.mark.parametrize(("line", "want"), [
    ("see basic authentication for more", "see basic authentication for more"),
    ('{"token":"a\\"b c","x":1}', '{"token":"[REDACTED]","x":1}'),
    ("mongodb://u:p@ss@h:1/db?x=y@z", "mongodb://u:[REDACTED]@h:1/db?x=y@z"),
    ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4\n\nabc\n-----END RSA PRIVATE KEY----- rest", "[REDACTED] rest"),
    ("-----BEGIN PRIVATE KEY-----\nabc", "[REDACTED]"),
    ("a -----BEGIN EC PRIVATE KEY-----\\nMHcC\\nAwE=\\n-----END EC PRIVATE KEY-----\\n b", "a [REDACTED]\\n b"),
    ("-----BEGIN RSA PRIVATE KEY-----\nMHcC\n-----END EC PRIVATE KEY-----", "[REDACTED]\n-----END EC PRIVATE KEY-----"),
    ("-----BEGIN OPENSSH PRIVATE KEY----- b3Bl bnNz -----END OPENSSH PRIVATE KEY----- {x}", "[REDACTED] {x}"),
    ("-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----", "-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----"),
    ("-----BEGIN PRIVATE KEY-----\nabc+/=\n{not: base64}", "[REDACTED]\n{not: base64}"),
    ("token='a b' pwd=x&y=1 Secret => zé9; api-key:k", "token='[REDACTED]' pwd=[REDACTED]&y=1 Secret => [REDACTED]; api-key:[REDACTED]"),
    ('{"password":"cut off', '{"password":"[REDACTED]'),
    ("password=[REDACTED] token=", "password=[REDACTED] token="),
    ("from a.b+c@mail.example.org to us", "from [REDACTED] to us"),
    ("card 4111 1111 1111 1111 and 378282246310005, not 12345", "card [REDACTED] and [REDACTED], not 12345"),
])
def test_redactions_by_format(spark, line, want):
    steps = logs.redactions(["defaults", "email", "credit-card"])
    assert spark.createDataFrame([(line,)], "x string").select(logs.scrub(F.col("x"), steps)).first()[0] == want


def test_policies_over_budget_leave_the_trace_to_the_next(spark):
    schema = "trace_id string, span_id string, service string, status string, start_ns long, end_ns long, arrival_ms long, attrs map<string,string>, resource map<string,string>"
    rows = [(f"t{k}", str(n), "s", "ERROR" if k != 3 else "UNSET", 1, 100, k * 10, {"x": "veto"} if k == 4 else {}, {}) for k in range(6) for n in range(5 if k == 0 else 2)]
    policies = [sampling.string_attribute("no", "x", ["veto"], invert=True), sampling.status_code("errors", ["ERROR"]), sampling.latency("slow", 0)]
    got = {r.trace_id: (r.policy, r.verdict) for r in sampling.composite(sampling.summaries(spark.createDataFrame(rows, schema), policies), policies, {"errors": 40, "slow": 40}, 10).collect()}
    # errors may use 4: the first trace takes 5, in debt; the next go to slow, which has 4 for two of them
    assert got == {"t0": ("errors", "sample"), "t1": ("slow", "sample"), "t2": ("slow", "sample"), "t3": ("", "drop"), "t4": ("no", "veto"), "t5": ("", "drop")}
    for shares in ({"errors": 90, "slow": 20}, {"other": 5}, {"errors": 100}):
        with pytest.raises(ValueError):
            sampling.composite(spark.createDataFrame([], schema), policies, shares, 10)


def test_chunks_keep_their_cap(spark):
    sizes = [3, 4, 5, 30, 1, 1, 9, 9, 2, 10, 10, 1]
    got = writers.assign_size_chunks(spark.createDataFrame([("k", n, s) for n, s in enumerate(sizes)], "k string, n int, s int"), ["k"], F.col("s"), ["n"], 10).orderBy("n").collect()
    chunks: dict = {}
    for r in got:
        chunks.setdefault(r.chunk, []).append(r.s)
    assert [s for c in sorted(chunks) for s in chunks[c]] == sizes and all(sum(c) <= 10 or len(c) == 1 for c in chunks.values())


def test_attribution_takes_the_latest_live_incarnation(spark):
    pods = spark.createDataFrame([("u1", "ns", "p", "c", "1.1.1.1", False, 1, False, "Running"), ("u2", "ns", "p", "c", "1.1.1.2", False, 2, False, "Running"), ("u3", "ns", "p", "c", "1.1.1.3", True, 9, False, "Running")], "uid string, namespace string, name string, container_id string, ip string, terminating boolean, claim_seq long, host_network boolean, phase string")
    rows = spark.createDataFrame([("c", None, None, None), (None, "ns", "p", None), (None, None, "p", "1.1.1.1"), (None, None, None, None)], "container_id string, namespace string, pod string, peer_ip string")
    got = kubernetes.attribute_to_pods(rows, pods)
    assert sorted(map(str, ((r.pod_uid, r.found_by) for r in got.collect()))) == sorted(map(str, [("u2", "container"), ("u2", "name"), ("u1", "ip"), (None, "none")])) and got.columns == [*rows.columns, "pod_uid", "found_by"]


def test_facts_that_repeat_are_looked_up_as_often(spark):
    intervals = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, None, 2)], "pod string, valid_from long, valid_to long, version int")
    facts = spark.createDataFrame([("a", 5), ("a", 5), ("a", 12), ("b", 1), (None, 1)], "pod string, at long")
    got = kubernetes.as_of(facts, intervals, "pod", "at").collect()
    assert sorted(((r.pod, r.at, r.version) for r in got), key=str) == sorted([("a", 5, 1), ("a", 5, 1), ("a", 12, 2), ("b", 1, None), (None, 1, None)], key=str)


def test_trace_taps_see_all_spans(spark):
    from obslake.plans.views import span_table

    table, seen = span_table(spark, "/root/testdata/sf0.001"), {}
    chain = TraceChain([sampling.status_code("errors", ["ERROR"])], head_share=0.2)
    batch_writer(chain, lambda name, rows, number: seen.update({name: rows.collect()}))(table, 1)
    assert set(seen) == {"edges", "red", "decisions", "exported"} and sum(r["calls"] for r in seen["red"]) > len(seen["exported"])
