"""Rules whose verdict on a row depends on the verdicts before it: token buckets, throttles, rates between accepted readings.

What can be known without the earlier verdicts is computed with aggregations and windows; only stretches in which they matter go through a fold, which
reads sorted rows one by one and holds a state of constant (a throttle: bounded) size. Times are microseconds, and all arithmetic is in whole numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = "decimal(38,0)"
#: Ticks in the time that a bucket takes to fill; blocks of time that window functions see at once, in such times.
_TICKS, _FILLS = 4, 16


def _folded(df: DataFrame, unit: str, order: list[str], inputs: list[str], outputs: list[tuple[str, T.DataType]], begin: Callable[[], Callable]) -> DataFrame:
    """df with further columns: for each unit, in order, what the function that begin() returns says of the inputs."""
    arrow = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in outputs)])
    types = [arrow[t] for _, t in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, begin()
        for batch in batches:
            out = []
            for u, *values in zip(batch.column(unit).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if u != now:
                    now, step = u, begin()
                out.append(step(*values))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *(n for n, _ in outputs)])

    # dealt by a hash of the unit: an exchange by the unit itself would be left out after a join on it, which may then read its own exchange in another order
    return df.repartition(F.xxhash64(unit)).sortWithinPartitions(unit, *order).mapInArrow(run, schema)


def token_bucket(rows: DataFrame, rate: float, at_us: str, order: list[str], size: Column | None = None, keys: tuple[str, ...] = (), burst: float | None = None, debt: bool = True) -> DataFrame:
    """rows with `admitted` by a bucket for each of keys that begins full, gains `rate` tokens a second and holds `burst` (default: the rate, 1 at least).

    A row of size n (default 1) is admitted if the bucket holds min(n, burst) tokens and is charged n, so one larger than the bucket leaves a debt that later
    rows wait for; without debt it has to hold all n. Refused rows are charged nothing. Rows are taken by time, then `order`; a null time is 0, a null or negative size 0.

    A bucket that had been charged for every row offered is never fuller than the real one. Where that one is surely full at the first row of a tick (a part of the time that a
    bucket takes to fill), the real one is, and what follows is a stretch that is folded for itself. What a key is offered is summed up tick by tick, in blocks of
    ticks and over the blocks, so rows are moved only to be folded, and to find their stretch where blocks are too many to be broadcast.
    """
    rate_, burst_ = Fraction(rate).limit_denominator(10**6), Fraction(max(1, rate) if burst is None else burst).limit_denominator(10**6)
    if rate_ <= 0 or burst_ <= 0:
        raise ValueError("rate and burst have to be positive")
    per = lcm(rate_.denominator, burst_.denominator)
    # a token is `token` parts; `gain` parts come in a microsecond
    token, gain = per * 10**6, int(rate_ * per)
    full = int(burst_ * token)
    tick = max(1, full // gain // _TICKS)
    own = rows.columns
    n = F.greatest(F.coalesce(F.lit(1) if size is None else size, F.lit(0)).cast("long"), F.lit(0))
    base = rows.withColumns({"_at": F.coalesce(F.col(at_us).cast("long"), F.lit(0)), "_n": n, "_key": F.struct(*(keys or (F.lit(0).alias("all"),)))})
    base = base.withColumn("_tick", F.floor(F.col("_at") / tick)).withColumn("_block", F.floor(F.col("_tick") / (_TICKS * _FILLS)))
    ticks = base.groupBy("_key", "_block", "_tick").agg(F.sum("_n").cast(_WIDE).alias("_sum"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    earlier = Window.partitionBy("_key", "_block").orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)
    offered = (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) * token).cast(_WIDE)
    # of the first row, and no more than that of any row of the tick
    ticks = ticks.withColumn("_w", (offered - F.col("_first").cast(_WIDE) * gain).cast(_WIDE)).withColumn("_least", (F.col("_w") - (F.col("_last") - F.col("_first")).cast(_WIDE) * gain).cast(_WIDE))
    ticks = ticks.withColumn("_low", F.min("_least").over(earlier))
    # whether the bucket is full at the tick if it was at the block's begin, and what the blocks before may have left at most for that
    full_at = F.when(F.col("_low").isNull() | (F.col("_w") <= F.col("_low")), F.struct("_tick", "_w"))
    blocks = ticks.groupBy("_key", "_block").agg(F.sum("_sum").cast(_WIDE).alias("_sum"), F.min("_least").alias("_least"), F.collect_list(full_at).alias("_full"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", (F.coalesce(F.sum("_sum").over(before), F.lit(0)) * token).cast(_WIDE))
    blocks = blocks.withColumn("_lowest", F.min((F.col("_base") + F.col("_least")).cast(_WIDE)).over(before))
    cuts = F.filter("_full", lambda c: F.col("_lowest").isNull() | ((F.col("_base") + c["_w"]).cast(_WIDE) <= F.col("_lowest")))
    blocks = blocks.withColumn("_cuts", F.transform(cuts, lambda c: c["_tick"]))
    blocks = blocks.withColumn("_since", F.max(F.array_max("_cuts")).over(before)).select("_key", "_block", "_cuts", "_since")
    cut = F.coalesce(F.array_max(F.filter("_cuts", lambda c: c <= F.col("_tick"))), F.col("_since"))
    met = base.join(blocks, ["_key", "_block"]).withColumn("_unit", F.concat_ws("/", F.to_json("_key", {"ignoreNullFields": "false"}), cut.cast("string")))
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, last = None, full, 0
        for batch in batches:
            unit, at, sizes = batch.column("_unit"), batch.column("_at").to_pylist(), batch.column("_n").to_pylist()
            admitted = np.zeros(len(at), dtype=bool)
            begins = [0, *(np.flatnonzero(pc.not_equal(unit[1:], unit[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(at)]
            for k, end in zip(begins, begins[1:]):
                if k == end:
                    continue
                if (name := unit[k].as_py()) != now:
                    now, tokens, last = name, full, at[k]
                least = min(min(sizes[k:end]) * token, full) if debt else min(sizes[k:end]) * token
                while k < end:
                    tokens, last = min(full, tokens + gain * (at[k] - last)), at[k]
                    charge = sizes[k] * token
                    if tokens >= (min(charge, full) if debt else charge):
                        tokens -= charge
                        admitted[k] = True
                        k += 1
                    else:
                        # the refused leave the bucket as it is: on to the first that comes when it holds enough for the smallest
                        k = bisect_left(at, last - (tokens - least) // gain, k + 1, end)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(admitted)], [*own, "admitted"])

    # dealt by a hash of the unit: see _folded()
    dealt = met.select(*own, "_at", "_n", "_unit").repartition(F.xxhash64("_unit")).sortWithinPartitions("_unit", "_at", *order)
    return dealt.mapInArrow(run, schema)


def throttle(rows: DataFrame, keys: list[str], at_us: str, order: list[str], window_us: int, max_keys: int | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """rows with `allowed`: the first of a key, and each first one that comes at least window_us after the last allowed (0: never again); and `saturated`.

    max_keys: each scope's table holds no more keys. Where a key that isn't in it finds it full, keys whose window is over leave; if none does, the row is refused
    and the key isn't entered, and the first such row of a scope has `saturated`. A key in the table isn't affected by that. Null keys are keys.
    Times at which a key comes more than once count once; a scope with no more keys than its table holds is folded key by key.
    """
    own = rows.columns
    base = rows.withColumns({"_at": F.coalesce(F.col(at_us).cast("long"), F.lit(0)), "_scope": F.struct(*(scope or (F.lit(0).alias("all"),))), "_name": F.struct(*keys)})
    base = base.withColumns({"_scope": F.to_json("_scope", {"ignoreNullFields": "false"}), "_name": F.to_json("_name", {"ignoreNullFields": "false"})})
    events = base.groupBy("_scope", "_name", "_at").agg(F.min(F.struct(*order)).alias("_o"))
    most = max(1, max_keys) if max_keys is not None else None
    if window_us <= 0:
        first = events.groupBy("_scope", "_name").agg(F.min(F.struct("_at", "_o")).alias("_f"))
        if most is not None:
            nth = F.row_number().over(Window.partitionBy("_scope").orderBy("_f", "_name"))
            first = first.withColumn("_nth", nth).filter(F.col("_nth") <= most + 1)
        else:
            first = first.withColumn("_nth", F.lit(0))
        limit = F.col("_nth") <= (most if most is not None else 0)
        found = first.select("_scope", "_name", F.col("_f._at").alias("_at"), F.col("_f._o").alias("_o"), limit.alias("allowed"), (~limit).alias("saturated"))
    else:
        if most is None:
            units = events.withColumn("_unit", F.concat_ws("/", "_scope", "_name"))
        else:
            wide = events.groupBy("_scope").agg(F.count_distinct("_name").alias("_keys"))
            units = events.join(wide, "_scope").withColumn("_unit", F.when(F.col("_keys") > most, F.col("_scope")).otherwise(F.concat_ws("/", "_scope", "_name"))).drop("_keys")

        def begin() -> Callable:
            seen: OrderedDict[str, int] = OrderedDict()  # by the time of the last allowed row
            told = False

            def step(name: str, at: int) -> tuple[bool, bool]:
                nonlocal told
                if name in seen:
                    if at - seen[name] < window_us:
                        return False, False
                elif most is not None and len(seen) >= most:
                    while seen and at - next(iter(seen.values())) >= window_us:
                        seen.popitem(last=False)
                    if len(seen) >= most:
                        first, told = not told, True
                        return False, first
                seen[name] = at
                seen.move_to_end(name)
                return True, False

            return step

        folded = _folded(units, "_unit", ["_at", "_o"], ["_name", "_at"], [("allowed", T.BooleanType()), ("saturated", T.BooleanType())], begin)
        found = folded.filter("allowed or saturated").drop("_unit")
    # of the rows of that key and time, the first
    flags = base.join(found, ["_scope", "_name", "_at"], "left").withColumn("_marked", F.col("_o").isNotNull())
    marked = flags.filter("_marked").withColumn("_nth", F.row_number().over(Window.partitionBy("_scope", "_name", "_at").orderBy(*order)))
    marked = marked.select(*own, ((F.col("_nth") == 1) & F.col("allowed")).alias("allowed"), ((F.col("_nth") == 1) & F.col("saturated")).alias("saturated"))
    return marked.unionByName(flags.filter(~F.col("_marked")).select(*own, F.lit(False).alias("allowed"), F.lit(False).alias("saturated")))


def accepted_readings(readings: DataFrame, keys: list[str], at_us: str, counter: str, least_us: int) -> DataFrame:
    """readings with `base_at` and `base_counter`: time and count of the last accepted reading before, null for the first; and `accepted`.

    A reading is accepted, and is the next one's base, if it is the first, if the counter fell, or if at least least_us passed since the base. Others leave the base where it is.
    """
    own = readings.columns
    unit = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    base = readings.withColumns({"_unit": unit, "_at": F.col(at_us).cast("long"), "_count": F.col(counter).cast("long")})

    def begin() -> Callable:
        held: tuple[int, int] | None = None

        def step(at: int | None, count: int | None) -> tuple[int | None, int | None, bool]:
            nonlocal held
            was = held or (None, None)
            if at is None or count is None:
                return *was, False
            taken = held is None or count < held[1] or at - held[0] >= least_us
            if taken:
                held = (at, count)
            return *was, taken

        return step

    long, flag = T.LongType(), T.BooleanType()
    out = _folded(base, "_unit", ["_at", "_count"], ["_at", "_count"], [("base_at", long), ("base_counter", long), ("accepted", flag)], begin)
    return out.select(*own, "base_at", "base_counter", "accepted")
