"""Sinks: routed writes, size chunks, taps, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_match


def write_routed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows into a folder for each value of column route. One job: it fails or succeeds as a whole."""
    df.write.mode(mode).partitionBy("route").parquet(path)


def routed_batches(path: str):
    """A foreachBatch function that writes each batch once: a batch that is tried again replaces what its first try left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    return write


def assign_size_chunks(df: DataFrame, keys: list[str], size: Column, order: list[str], max_bytes: int) -> DataFrame:
    """df with chunk: rows of a key in order, in chunks of at most max_bytes; a row over that is alone in its chunk.

    A row within two multiples of max_bytes of the running size goes with the others there; one across a multiple is a chunk of
    its own. So chunks need no row-by-row state and keep their order.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    room = (F.floor(before / F.lit(max_bytes)) + 1) * max_bytes - before
    return df.withColumn("chunk", 2 * F.floor(before / F.lit(max_bytes)) + (size > room).cast("long"))


def tap(df: DataFrame, globs: list[tuple[str, str]], percent: float = 100, identity: list[str] = ()) -> DataFrame:
    """The rows whose resource has, for each (key glob, value glob), an attribute that matches both; a share of them by a hash of identity."""
    out = F.lit(True)
    for key, value in globs:
        out = out & F.exists(F.map_entries("resource"), lambda e: glob_match(key, e["key"]) & glob_match(value, e["value"]))  # noqa: B023
    if percent < 100:
        out = out & (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *identity)), 1, 8), 16, 10).cast("long"), F.lit(10_000)) < round(percent * 100))
    return df.filter(out)


def published(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df that, when it runs, counts its rows and those where each condition holds."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items())), seen
