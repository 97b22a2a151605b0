"""Resource usage distributions from cumulative CPU readings and memory readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import accepted_readings


def cpu_rates(readings: DataFrame, key: str = "container", ts_us: str = "ts_us", least_us: int = 0) -> DataFrame:
    """readings (key, ts_us, usage_usec, memory_bytes, inactive_bytes) with cores and working_set.

    cores is the growth of usage over the time since the reading before; a fall of the counter starts anew without a value. least_us: a reading
    that follows its base more closely gives no value and doesn't become the next one's base, so its growth counts in the next interval.
    """
    if least_us > 0:
        out = accepted_readings(readings, [key], ts_us, "usage_usec", least_us)
        grown, took = F.col("usage_usec") - F.col("base_counter"), F.col(ts_us) - F.col("base_at")
        out = out.withColumn("cores", F.when(F.col("accepted") & (grown >= 0) & (took > 0), grown / took)).drop("base_at", "base_counter", "accepted")
        return out.withColumn("working_set", F.greatest(F.col("memory_bytes") - F.col("inactive_bytes"), F.lit(0).cast("long")))
    w = Window.partitionBy(key).orderBy(ts_us, "usage_usec")
    used, passed = F.col("usage_usec") - F.lag("usage_usec").over(w), F.col(ts_us) - F.lag(ts_us).over(w)
    return readings.withColumn("cores", F.when((used >= 0) & (passed > 0), used / passed)).withColumn("working_set", F.greatest(F.col("memory_bytes") - F.col("inactive_bytes"), F.lit(0).cast("long")))


def usage_distribution(readings: DataFrame, window_us: int, key: str = "container", ts_us: str = "ts_us") -> DataFrame:
    """For each container and window: samples, mean, stddev (population), min and max of CPU cores and of memory. Windows with under two readings give nothing.

    The moments merge across partial aggregates without losing precision to a large mean.
    """
    window = F.expr(f"{ts_us} div {window_us}").alias("window")
    columns = []
    for name, c in (("cpu", "cores"), ("memory", "working_set")):
        x = F.col(c).cast("double")
        columns += [F.count(x).alias(f"{name}_samples"), F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_stddev"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
    return cpu_rates(readings, key, ts_us).groupBy(key, window).agg(*columns).filter("cpu_samples >= 2")


def hold(windows: DataFrame, key: str, columns: list[str], most: int = 2) -> DataFrame:
    """A row for each window between a container's first and last, the last measured values repeated at most `most` times; then none."""
    ends = windows.groupBy(key).agg(F.min("window").alias("a"), F.max("window").alias("b"))
    spine = ends.select(key, F.explode(F.sequence("a", "b")).alias("window"))
    w = Window.partitionBy(key).orderBy("window").rowsBetween(-most, 0)
    out = spine.join(windows.select(key, "window", *columns), [key, "window"], "left")
    return out.select(key, "window", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns)).filter(F.col(columns[0]).isNotNull())
