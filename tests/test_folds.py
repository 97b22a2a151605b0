"""Buckets, throttles and accepted readings against folds over plain lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obslake.operators import folds, logs, sampling, usage

SECOND = 1_000_000


def _bucket(rows, rate, burst, debt):
    """Ids admitted; rows (id, key, at, n) are taken by key, time and id."""
    out, state = [], {}
    for i, key, at, n in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        tokens, last = state.get(key, (burst, at))
        tokens = min(burst, tokens + rate * (at - last) / SECOND)
        if tokens + 1e-9 >= (min(n, burst) if debt else n):
            out.append(i)
            tokens -= n
        state[key] = (tokens, at)
    return sorted(out)


@pytest.mark.parametrize(("rate", "burst", "debt"), [(10, None, True), (0.5, None, True), (4, 2, False), (3, 7, True)])
def test_buckets_are_those_of_a_fold(spark, rate, burst, debt):
    rng = random.Random(rate)
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice([0, 1, 125_000, 250_000, SECOND, SECOND, 20 * SECOND if i % 50 == 0 else 500_000])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), at, rng.choice([0, 1, 1, 2, 5, 40])))
    frame = spark.createDataFrame(rows, "id long, k string, at long, n long").repartition(4)
    out = folds.token_bucket(frame, rate, "at", ["id"], F.col("n"), ("k",), burst, debt)
    assert out.count() == len(rows)
    assert sorted(r.id for r in out.filter("admitted").collect()) == _bucket(rows, rate, max(1, rate) if burst is None else burst, debt)


def test_burst_refill_and_debt(spark):
    traces = [(f"a{k:02}", 2, 0) for k in range(20)] + [(f"b{k:02}", 2, 500) for k in range(20)]
    frame = spark.createDataFrame(traces, "trace_id string, n_spans long, first_ms long")
    kept = sampling.rate_limiting(frame, 10).filter("admitted").collect()
    assert sum(r.trace_id[0] == "a" for r in kept) == 5 and sum(r.trace_id[0] == "b" for r in kept) == 2
    big = spark.createDataFrame([("big", 50, 0)] + [(f"s{k}", 1, 1000 * k) for k in range(1, 7)], "trace_id string, n_spans long, first_ms long")
    assert sorted(r.trace_id for r in sampling.rate_limiting(big, 10).filter("admitted").collect()) == ["big", "s5", "s6"]
    none = frame.limit(0)
    assert sampling.rate_limiting(none, 10).count() == 0
    with pytest.raises(ValueError):
        sampling.rate_limiting(frame, 0)


def test_only_stretches_in_doubt_are_folded(spark):
    """Spread-out rows never reach Python: their fold gets no rows, whatever it would say of them."""
    rows = spark.range(2000).select("id", (F.col("id") * 2 * SECOND).alias("at"))
    plan = folds.token_bucket(rows, 1, "at", ["id"])
    assert plan.filter("admitted").count() == 2000
    burst = rows.unionByName(spark.range(5000, 5100).select("id", F.lit(10 * SECOND).alias("at")))
    assert folds.token_bucket(burst, 1, "at", ["id"]).filter("not admitted").count() >= 100


def test_a_bucket_reads_its_rows_twice(spark):
    """Once to sum them up by ticks, once to fold them, however many are refused."""
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.floor(F.col("id") * 7919 % 3000 * SECOND / 40).alias("at"))
    out = folds.token_bucket(rows, 1 / 7, "at", ["id"], keys=("k",), burst=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert sorted(r.id for r in out.filter("admitted").collect()) == _bucket([(r.id, r.k, r.at, 1) for r in rows.collect()], 1 / 7, 2, True)


def test_records_through_a_bucket(spark):
    rows = [(k, "a", 0) for k in range(5)] + [(10 + k, "a", SECOND) for k in range(5)] + [(20, "b", 0)]
    frame = spark.createDataFrame(rows, "id long, k string, at long")
    got = logs.bucket_limit(frame, ["k"], 2, 3, "at", ["id"])
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 10, 11, 20] and got.columns == frame.columns


def _table(rows, window, most):
    """(ids allowed, ids that found the table full first) of one table; rows (id, key, at)."""
    seen, told, allowed, full = {}, False, [], []
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key in seen:
            if window <= 0 or at - seen[key] < window:
                continue
        elif most is not None and len(seen) >= most:
            if window > 0:
                seen = {k: t for k, t in seen.items() if at - t < window}
            if len(seen) >= most:
                if not told:
                    full.append(i)
                told = True
                continue
        seen[key] = at
        allowed.append(i)
    return allowed, full


@pytest.mark.parametrize(("window", "most"), [(50, None), (50, 4), (0, 4), (0, None), (400, 7), (50, 1000)])
def test_throttles_are_those_of_a_table(spark, window, most):
    rng = random.Random(window)
    rows = [(i, f"s{rng.randrange(3)}", rng.choice([None, *"abcdefghij"]), rng.randrange(2000)) for i in range(1200)]
    frame = spark.createDataFrame(rows, "id long, scope string, k string, at long").repartition(4)
    out = folds.throttle(frame, ["k"], "at", ["id"], window, most, ("scope",))
    want = [_table([(i, k, t) for i, sc, k, t in rows if sc == s], window, most) for s in ("s0", "s1", "s2")]
    assert out.count() == len(rows)
    assert sorted(r.id for r in out.filter("allowed").collect()) == sorted(i for a, _ in want for i in a)
    assert sorted(r.id for r in out.filter("saturated").collect()) == sorted(i for _, f in want for i in f)


def test_base_moves_only_with_accepted_readings(spark):
    rows = [(1, 0, 0), (2, SECOND, 1_000_000), (3, 1_200_000, 2_000_000), (4, 2_600_000, 4_000_000), (5, 2_700_000, 100), (6, 2_800_000, 200), (7, 3_800_000, 500_200)]
    frame = spark.createDataFrame([(1, *r, 10, 20) for r in rows] + [(2, 1, 0, 5, 10, 3)], "c long, id long, ts_us long, usage_usec long, memory_bytes long, inactive_bytes long")
    got = {(r.c, r.id): (r.cores, r.working_set) for r in usage.cpu_rates(frame, "c", "ts_us", 500_000).collect()}
    # 3 and 6 come too soon, and their time counts in 4's and 7's intervals; 5 starts the counter anew
    assert got[1, 1][0] is got[1, 3][0] is got[1, 5][0] is got[1, 6][0] is None
    assert [round(got[1, k][0], 6) for k in (2, 4, 7)] == [1.0, round(3_000_000 / 1_600_000, 6), round(500_100 / 1_100_000, 6)]
    assert got[2, 1] == (None, 7) and got[1, 1][1] == 0


def test_buckets_stay_whole_after_a_join_that_is_replanned(spark):
    """The join with the stretches in doubt is planned by size and turns out small: it then reads its own exchange in any order, the fold has to have another."""
    rows = [(k, i, (i * 977 + k * 131) % 40_000 * 20 * 10**6, (i % 5 + 1) * 18) for k in range(6) for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, i long, at long, n long").repartition(4, "i")
    want = {}
    for k in range(6):
        tokens, last = 100 * 10**6, None
        for _, i, at, n in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            tokens, last = tokens if last is None else min(100 * 10**6, tokens + (at - last) // 50), at
            want[k, i] = tokens >= n * 10**6
            tokens -= n * 10**6 if want[k, i] else 0
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c, None) for c in limits}
    try:
        for c, v in limits.items():
            spark.conf.set(c, v)
        out = folds.token_bucket(frame, 1 / 50, "at", ["i"], F.col("n"), ("k",), burst=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.i): r.admitted for r in out.collect()}
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert 0 < sum(want.values()) < len(want) and got == want
    below = plan.split("MapInArrow")[1].splitlines()[1:3]
    assert "Sort" in below[0] and "Exchange" in below[1]
