"""Pods, names and containers over time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from obslake.operators import incarnations as inc
from obslake.operators import kubernetes as k8s

SCHEMA = "uid string, ts long, deleted boolean, namespace string, name string, containers array<struct<id:string,name:string>>, note string"


def _frame(spark, rows):
    return spark.createDataFrame([(u, t, gone, "ns", n, [(c, "app") for c in cs], "x") for u, t, gone, n, cs in rows], SCHEMA).repartition(3)


#: The first pod's deletion is never seen; the name goes to the second at 30, which restarts its container at 40 and is deleted at 60.
ROWS = [("u1", 10, False, "db-0", ["c1"]), ("u1", 20, None, "db-0", ["c1", ""]), ("u2", 30, False, "db-0", ["c2"]), ("u2", 40, False, "db-0", ["c3"]), ("u2", 60, True, "db-0", ["c3"]), ("w", 5, False, "web", ["c9"])]


def test_intervals_end_with_replacement_restart_and_deletion(spark):
    pods = inc.pod_intervals(_frame(spark, ROWS), "ts").cache()
    got = sorted((r.uid, r.valid_from, r.valid_to, r.ended_by) for r in pods.collect())
    assert got == [("u1", 10, 20, "updated"), ("u1", 20, 30, "replaced"), ("u2", 30, 40, "updated"), ("u2", 40, 60, "deleted"), ("w", 5, None, None)]
    containers = inc.container_intervals(pods).cache()
    assert sorted((r.container_id, r.uid, r.valid_from, r.valid_to, r.ended_by) for r in containers.collect()) == [
        ("c1", "u1", 10, 30, "replaced"), ("c2", "u2", 30, 40, "restarted"), ("c3", "u2", 40, 60, "deleted"), ("c9", "w", 5, None, None)]
    names = {(r.name, r.uid): (r.valid_from, r.valid_to) for r in inc.name_intervals(pods, 15).collect()}
    assert names == {("db-0", "u1"): (10, 30), ("db-0", "u2"): (30, 75), ("web", "w"): (5, None)}
    # a container that was restarted away is still found for its time to live
    facts = spark.createDataFrame([("c2", 35), ("c2", 49), ("c2", 50), ("c1", 39), ("c9", 1000), ("none", 1)], "cid string, at long")
    found = {(r.cid, r.at): r.uid for r in k8s.as_of(facts, containers.withColumnRenamed("container_id", "cid"), "cid", "at", ttl=10).collect()}
    assert found == {("c2", 35): "u2", ("c2", 49): "u2", ("c2", 50): None, ("c1", 39): "u1", ("c9", 1000): "w", ("none", 1): None}


def test_a_replaced_pod_that_speaks_again_takes_its_name_back(spark):
    rows = [("a", 1, False, "n", []), ("b", 5, False, "n", []), ("a", 7, False, "n", []), ("b", 9, True, "n", []), ("a", 9, True, "n", [])]
    got = sorted((r.uid, r.valid_from, r.valid_to, r.ended_by) for r in inc.pod_intervals(_frame(spark, rows), "ts").collect())
    assert got == [("a", 1, 5, "replaced"), ("a", 7, 9, "deleted"), ("b", 5, 7, "replaced")]
    assert inc.pod_intervals(_frame(spark, rows).limit(0), "ts").count() == 0


def test_holders_are_those_of_a_replay(spark):
    """At every instant the pods that are valid are those that a store fed event by event holds."""
    rng = random.Random(3)
    seen, rows = set(), []
    for _ in range(250):
        u, t = rng.randrange(9), rng.randrange(400)
        if (u, t) not in seen:
            seen.add((u, t))
            rows.append((f"u{u}", t, rng.random() < 0.25, f"n{u // 3}", [f"c{u}-{t // 50}"]))
    out = inc.pod_intervals(_frame(spark, rows), "ts").select("uid", "valid_from", F.coalesce("valid_to", F.lit(10**6)).alias("to")).collect()
    live, by_time = {}, {}
    for u, t, gone, n, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if gone:
            live.pop(u, None)
        else:
            for other in [o for o, name in live.items() if name == n and o != u]:
                del live[other]
            live[u] = n
        by_time[t] = set(live)
    now = set()
    for t in range(400):
        now = by_time.get(t, now)
        assert {r.uid for r in out if r.valid_from <= t < r.to} == now, t
