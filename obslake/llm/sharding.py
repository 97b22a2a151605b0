"""Shards of linked documents by balanced label propagation: few cut links, equal counts.

Documents with one link key (by default: equal texts) are linked with each other. They begin in shards dealt round robin. In each round the documents
of a group that stand in one shard ask to go where more of their group are; how many may go from which shard to which is limited: what two shards
send each other may be exchanged, and beyond that a shard takes no more than its quota has room for. Those with most to gain go first, and
a set that only fits in part is divided there. Two places of a group stay where they are in a round, its largest and its largest in a shard with room, and
a move leads to a place that is no smaller, so the number of uncut links only grows. Documents without links make room: they fill what is left of
every quota at the end, dealt by size, so that bytes come out even too.

Members of a group within a shard are alike, so rounds work on (group, shard, count): a group of any size is at most as many rows as there are shards. Limits are
found with prefix sums over buckets that are aggregated first. Documents are numbered by a sort over all of them (ids and row numbers are
part of its key), so no group, id or shard is gathered in one task. The driver sees shards x shards numbers of a round, and a count for each partition.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

SHARDS, ROUNDS = 16, 24
#: Buckets of a prefix sum; columns that unlinked documents are dealt into by size.
BUCKETS, STRIDE = 1024, 1024


def numbered(df: DataFrame, name: str, *order: Column | str) -> tuple[DataFrame, int]:
    """df, stored, with its rows' places from 0 in a total order, in the column `name`; and the number of rows."""
    dealt = df.withColumn("of_row", F.monotonically_increasing_id()).repartitionByRange(*order, "of_row").sortWithinPartitions(*order, "of_row").drop("of_row")
    marked = dealt.select("*", F.spark_partition_id().alias("of_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(name))
    rows = stored(marked, name)
    total, before = 0, []
    for r in rows.groupBy("of_part").count().orderBy("of_part").collect():  # a row for each partition
        before.append((r.of_part, total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "of_part int, of_before long")
    return rows.join(F.broadcast(offsets), "of_part").withColumn(name, F.col(name) + F.col("of_before")).drop("of_part", "of_before"), total


def _running(df: DataFrame, amount: str, apart: list[str], order: list[Column], bucket: Column, within: list[str]) -> DataFrame:
    """df with `before`: the sum of `amount` over the rows of the same `apart` that come earlier by order, bucket and `within`."""
    keyed = df.withColumn("of_bucket", bucket)
    names = [*apart, *(f"of_order{k}" for k in range(len(order))), "of_bucket"]
    keyed = keyed.withColumns({f"of_order{k}": o for k, o in enumerate(order)})
    sums = keyed.groupBy(*names).agg(F.sum(amount).alias("of_sum"))
    earlier = Window.partitionBy(*apart).orderBy(*names[len(apart) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("of_earlier", F.sum("of_sum").over(earlier) - F.col("of_sum")).drop("of_sum")
    inside = Window.partitionBy(*names).orderBy(*within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.join(sums, names).withColumn("before", F.col("of_earlier") + F.sum(amount).over(inside) - F.col(amount)).drop("of_earlier", *names[len(apart) :])


def _quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from s to t: as many as come back, and besides them as many as t has room for, most wanted first."""
    out = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    room = list(room)
    for (s, t), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[s, t], room[t])
        out[s, t] += more
        room[t] -= more
    return {k: n for k, n in out.items() if n > 0}


def _requests(state: DataFrame, room: list[int], turn: int) -> DataFrame:
    """(g1, g2, s, t, n, gain): sets of a group's documents that ask to go from s to t, where gain of their group are.

    Which of two equal places asks depends on the turn, so that what couldn't be exchanged in one may be in another.
    """
    has_room = F.array(*[F.lit(int(r > 0)) for r in room])
    places = F.transform("places", lambda c: F.struct(c.n.alias("n"), F.element_at(has_room, c.shard + 1).alias("room"), F.xxhash64("g1", c.shard, F.lit(turn)).alias("tie"), c.shard.alias("shard")))
    rows = state.select("g1", "g2", F.sort_array(places, asc=False).alias("places"))
    at = F.array_position(F.transform("places", lambda c: c.room), 1).cast("int")  # from 1; 0: none has room
    rows = rows.withColumn("at", F.when(at > 0, at - 1).otherwise(F.size("places")))
    roomy, top = F.get("places", F.col("at")), F.get("places", F.lit(0))

    def asks(c: Column, i: Column) -> Column:
        to = F.when(i > F.col("at"), roomy).otherwise(top)
        stays = (i == 0) | (i == F.col("at"))
        return F.when(~stays, F.struct(c.shard.alias("s"), to.shard.alias("t"), c.n.alias("n"), to.n.alias("gain")))

    return rows.select("g1", "g2", F.explode(F.transform("places", asks)).alias("r")).filter("r is not null").select("g1", "g2", "r.*")


def _together(cells: DataFrame) -> DataFrame:
    """(g1, g2, shard, n) with any number of rows a cell, to (g1, g2, places)."""
    once = cells.repartition("g1", "g2").groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
    return once.groupBy("g1", "g2").agg(F.collect_list(F.struct("n", "shard")).alias("places"))  # as many as there are shards


def propagate(state: DataFrame, quota: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """State (g1, g2, places) after rounds of moves, stored, and the number of linked documents in each shard. quota: the most a shard may hold."""
    spark = state.sparkSession
    idle = 0
    for left in range(rounds, -1, -1):
        held = defaultdict(int, {r.shard: r.n for r in state.select(F.explode("places").alias("c")).groupBy("c.shard").agg(F.sum("c.n").alias("n")).collect()})
        loads = [held[k] for k in range(len(quota))]
        if not left:
            break
        requests = _requests(state, [q - n for q, n in zip(quota, loads)], rounds - left)
        asked = {(r.s, r.t): r.n for r in requests.groupBy("s", "t").agg(F.sum("n").alias("n")).collect()}  # shards x shards
        allowed = _quotas(asked, [q - n for q, n in zip(quota, loads)])
        idle = 0 if allowed else idle + 1
        if not asked or idle > 1:
            break
        if not allowed:
            continue
        limits = spark.createDataFrame([(s, t, n) for (s, t), n in allowed.items()], "s int, t int, allowed long")
        rows = requests.join(F.broadcast(limits), ["s", "t"])
        rows = _running(rows, "n", ["s", "t"], [-F.floor(F.log2("gain"))], F.pmod("g1", F.lit(BUCKETS)), ["g1", "g2"])
        moved = rows.withColumn("n", F.least("n", F.col("allowed") - F.col("before"))).filter("n > 0")
        change = F.explode(F.array(F.struct(F.col("s").alias("shard"), (-F.col("n")).alias("n")), F.struct(F.col("t").alias("shard"), F.col("n").alias("n"))))
        cells = state.select("g1", "g2", F.explode("places").alias("c")).select("g1", "g2", "c.shard", "c.n")
        after = stored(_together(cells.unionByName(moved.select("g1", "g2", change.alias("c")).select("g1", "g2", "c.*"))), "places")
        drop_stored(state)
        state = after
    return state, loads


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, link: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs: counts of shards differ by one at most, slots of a shard run from 0 without a gap.

    link: documents where it is equal are linked (default: the text, null as empty); they share a shard as far as quotas allow. size: bytes of the text and one.
    A null text is an empty one; null ids and repeated rows are documents of their own; other columns are ignored; no rows: an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    link = text if link is None else link
    keyed = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(link).alias("g1"), F.xxhash64(F.lit(7), link).alias("g2")), "documents")
    ranked, total = numbered(keyed, "place", "g1", "g2", "doc_id")
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    groups = ranked.groupBy("g1", "g2").agg(F.count("*").alias("members"), F.min("place").alias("first")).filter("members > 1")
    # of places dealt round robin, those of a group in each shard
    late = F.pmod(F.col("shard") - F.col("first"), F.lit(shards))
    dealt = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("n", F.floor((F.col("members") - late + (shards - 1)) / shards))
    state = stored(dealt.filter("n > 0").groupBy("g1", "g2").agg(F.collect_list(F.struct("n", "shard")).alias("places")), "places")
    state, loads = propagate(state, quota, rounds)
    cells = state.select("g1", "g2", F.explode("places").alias("c")).select("g1", "g2", "c.shard", "c.n")
    slots = _running(cells, "n", ["shard"], [], F.pmod("g1", F.lit(BUCKETS)), ["g1", "g2"]).withColumnRenamed("before", "slot")
    upto = F.sum("n").over(Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = slots.withColumn("upto", upto).groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("upto", "n", "shard", "slot"))).alias("ends"))
    of_groups = groups.join(ends, ["g1", "g2"]).select("g1", "g2", "first", "ends")
    member = F.col("place") - F.col("first")
    mine = F.get(F.filter("ends", lambda e: member < e.upto), F.lit(0))
    linked = ranked.join(of_groups, ["g1", "g2"], "left").withColumn("mine", mine)
    slot = F.col("mine.slot") + member - (F.col("mine.upto") - F.col("mine.n"))
    rows = stored(linked.select("doc_id", "size", "text_crc32", "g1", F.col("mine.shard").cast("int").alias("shard"), slot.alias("slot")), "linked")
    alone, n_alone = numbered(rows.filter("shard is null").drop("shard", "slot"), "place", F.desc("size"), "g1", "doc_id")
    return rows.filter("shard is not null").drop("g1").unionByName(_fill(alone, n_alone, [q - n for q, n in zip(quota, loads)], loads).drop("g1"))


def _fill(alone: DataFrame, n: int, room: list[int], loads: list[int]) -> DataFrame:
    """Shards and slots of the n unlinked documents, numbered by size in `place`: each shard takes as many as it has room for, of all sizes."""
    k = len(room)
    wide = max(1, min(STRIDE, int(n**0.5)) // k)
    lines = n // (k * wide)
    line, column = F.floor(F.col("place") / (k * wide)), F.col("place") % (k * wide)
    # to and fro over the lines, and over the shards within a line, so that none has the largest of every turn; the short last line goes to the end
    column = F.when(line % 2 == 1, k * wide - 1 - column).otherwise(column)
    turn, of = F.floor(column / k), column % k
    block = F.when(turn % 2 == 1, k - 1 - of).otherwise(of)
    # the largest of a block in its middle: what falls to the neighbour where blocks and room differ is small
    nth, half = line * wide + turn, (wide * lines - 1) // 2
    inside = F.when(nth % 2 == 0, half - nth / 2).otherwise(half + (nth + 1) / 2).cast("long")
    at = F.when(line < lines, block * (wide * lines) + inside).otherwise(F.col("place"))
    begins = [sum(room[:k]) for k in range(len(room))]
    shard = F.lit(0)
    for s in range(1, len(room)):
        shard = shard + (at >= begins[s]).cast("int")
    out = alone.withColumn("at", at).withColumn("shard", shard)
    before, held = (F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard") + 1) for xs in (begins, loads))
    return out.withColumn("slot", held + F.col("at") - before).drop("at", "place")


def cut_links(assigned: DataFrame, key: str = "text_crc32") -> DataFrame:
    """(links, cut): pairs of documents with one key, and those of them in different shards, counted without forming pairs."""
    cells = assigned.groupBy(key, "shard").agg(F.count("*").cast("decimal(19,0)").alias("n"))
    squares = cells.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return squares.agg(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).cast("long").alias("links"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).cast("long").alias("cut"))
