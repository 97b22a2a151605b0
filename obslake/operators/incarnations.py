"""Validity of pods, their names and their containers from a change feed (slowly changing dimension, type 2).

An interval of a pod ends with its next event, its deletion, or an event of another pod under its name: the name was reused, so the old pod is gone though
its deletion may never have been seen. A container ends with the pod, or with an event that no longer lists it: it was restarted. What has ended stays
resolvable for a time to live, except a name, which its next holder takes at once. Each step is a window over one pod, one name or one container of the feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pod_intervals(changes: DataFrame, ts: str, deleted: str = "deleted") -> DataFrame:
    """changes (uid, namespace, name, ts, deleted, anything else) to valid_from, valid_to (null: still valid), ended_by and name_taken.

    ended_by: updated, deleted or replaced, null while valid. name_taken: when another pod came under the name (null: never). A later event of a replaced pod
    brings it back, and replaces the other in turn. Events of one time are taken by uid; of one pod's at one time the last by all its columns counts, and
    intervals without length are left out. Deletions end intervals and begin none. Null flags are no deletions.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False))
    names = [c for c in changes.columns if c not in (ts, "uid")]
    once = changes.groupBy("uid", ts).agg(F.max(F.struct(*names)).alias("_e")).select("uid", ts, "_e.*").withColumn("_gone", gone)
    own = Window.partitionBy("uid").orderBy(ts)
    rows = once.withColumns({"_next": F.lead(ts).over(own), "_next_gone": F.lead("_gone").over(own)}).filter(~F.col("_gone"))
    by_name = Window.partitionBy("namespace", "name")
    first = F.coalesce(F.col("uid") != F.lag("uid").over(by_name.orderBy(ts, "uid")), F.lit(True))
    rows = rows.withColumn("_first", F.when(first, F.col(ts)))
    # backwards, the last first row of a run that was passed is the one of the next run
    after = by_name.orderBy(F.desc(ts), F.desc("uid")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.last("_first", ignorenulls=True).over(after))
    until = F.least("_next", "_run")
    replaced = F.col("_run").isNotNull() & (F.col("_next").isNull() | (F.col("_run") <= F.col("_next")))
    ended = F.when(replaced, "replaced").when(F.col("_next_gone"), "deleted").when(F.col("_next").isNotNull(), "updated")
    out = rows.withColumns({"valid_from": F.col(ts), "valid_to": until, "ended_by": ended, "name_taken": F.col("_run")})
    return out.filter("valid_to is null or valid_to > valid_from").drop(ts, deleted, "_gone", "_next", "_next_gone", "_first", "_run")


def _merged(rows: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """Intervals that touch as one: the first one's columns `first`, the last one's `last`."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    begins = F.coalesce(F.lag("valid_to").over(w) < F.col("valid_from"), F.lit(True))
    run = F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = [F.min_by(c, "valid_from").alias(c) for c in first] + [F.max_by(c, "valid_from").alias(c) for c in last]
    return rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("valid_from").alias("_from"), *kept).drop("_run").withColumnRenamed("_from", "valid_from")


def name_intervals(intervals: DataFrame, ttl: int) -> DataFrame:
    """(namespace, name, uid, valid_from, valid_to): who a name stands for. A deleted pod keeps it for ttl, unless another takes it before."""
    runs = _merged(intervals, ["namespace", "name", "uid"], [], ["valid_to", "ended_by", "name_taken"])
    until = F.when(F.col("ended_by") == "replaced", F.col("valid_to")).otherwise(F.least(F.col("valid_to") + ttl, F.when(F.col("name_taken") > F.col("valid_from"), F.col("name_taken"))))
    return runs.select("namespace", "name", "uid", "valid_from", F.when(F.col("valid_to").isNotNull(), until).alias("valid_to"))


def container_intervals(intervals: DataFrame) -> DataFrame:
    """(container_id, container, uid, namespace, name, valid_from, valid_to, ended_by): pod_intervals() with containers array<struct<id,name>>, by container.

    ended_by restarted: the pod goes on without it. as_of() with a time to live finds containers that have ended, former incarnations too.
    """
    rows = intervals.select("uid", "namespace", F.col("name").alias("pod"), "valid_from", "valid_to", "ended_by", F.explode("containers").alias("c")).filter("c.id <> ''")
    rows = rows.select(F.col("c.id").alias("container_id"), F.col("c.name").alias("container"), "uid", "namespace", "pod", "valid_from", "valid_to", "ended_by")
    runs = _merged(rows, ["container_id", "uid"], ["container", "namespace"], ["pod", "valid_to", "ended_by"])
    ended = F.when(F.col("ended_by") == "updated", "restarted").otherwise(F.col("ended_by"))
    return runs.select("container_id", "container", "uid", "namespace", F.col("pod").alias("name"), "valid_from", "valid_to", ended.alias("ended_by"))
