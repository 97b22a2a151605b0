"""Edges between services from the two halves of each call.

The halves of a call share a trace id and a key: the client's span id, which is the server's parent. Instead of a join, both sides
are gathered by one aggregation on (trace, key), which needs one shuffle and combines duplicates before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EDGE_BOUNDS, span_nanos
from .spans import bucket_counts

#: Attributes that name a peer, in the order of preference.
PEERS = ("peer.service", "db.name", "db.system")
CLIENT, SERVER = ("CLIENT", "PRODUCER"), ("SERVER", "CONSUMER")


def halves(spans: DataFrame) -> DataFrame:
    """spans with side ('client', 'server'; null: none), key, and unkeyable where a half lacks service, trace or span id."""
    side = F.when(F.col("kind").isin(*CLIENT), "client").when(F.col("kind").isin(*SERVER), "server")
    key = F.when(side == "client", F.col("span_id")).otherwise(F.coalesce("parent_span_id", F.lit("")))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return spans.withColumn("side", side).withColumn("key", key).withColumn("unkeyable", F.col("side").isNotNull() & (missing("service") | missing("trace_id") | (F.col("side") == "client") & missing("span_id")))


def pair(spans: DataFrame, wait_ms: int = 10_000, peers: tuple[str, ...] = PEERS) -> DataFrame:
    """One row for each (trace_id, key): outcome 'completed', 'virtual' or 'unpaired', and the edge's columns.

    Of several halves of one side the last to arrive counts (ties by span id, service, end). Halves pair when they arrive less than wait_ms
    apart; otherwise each expires on its own, as one row each. An expired half with a peer attribute becomes an edge to a virtual node; db
    attributes don't name a peer of a server. Edge: client, server, connection_type, failed, client_ns, server_ns.
    """
    known = halves(spans).filter("side is not null and not unkeyable")
    half = F.struct(F.col("arrival_ms").alias("at"), "span_id", "service", (F.col("status") == "ERROR").alias("failed"), span_nanos("start_ns", "end_ns").alias("ns"), "kind", "attrs")
    last = lambda side: F.max_by(F.when(F.col("side") == side, half), F.when(F.col("side") == side, F.struct("arrival_ms", "span_id", "service", "end_ns", "start_ns", "kind", "status")))
    both = known.groupBy("trace_id", "key").agg(last("client").alias("c"), last("server").alias("s"))
    met = F.col("c").isNotNull() & F.col("s").isNotNull() & (F.abs(F.col("c.at") - F.col("s.at")) < wait_ms)
    alone = F.filter(F.array(F.struct(F.col("c"), F.lit(None).cast(both.schema["s"].dataType).alias("s")), F.struct(F.lit(None).cast(both.schema["c"].dataType).alias("c"), F.col("s"))), lambda e: e["c"].isNotNull() | e["s"].isNotNull())
    rows = both.select("trace_id", "key", F.explode(F.when(met, F.array(F.struct("c", "s"))).otherwise(alone)).alias("e")).select("trace_id", "key", "e.c", "e.s")
    attr = lambda half, name: F.col(f"{half}.attrs")[name]
    client_peer = F.coalesce(*(attr("c", p) for p in peers))
    server_peers = [p for p in peers if not p.startswith("db.")]
    server_peer = F.coalesce(*(attr("s", p) for p in server_peers)) if server_peers else F.lit(None).cast("string")
    paired = F.col("c").isNotNull() & F.col("s").isNotNull()
    has_db = F.coalesce(attr("c", "db.name"), attr("c", "db.system")).isNotNull()
    messaging = F.coalesce(F.col("c.kind") == "PRODUCER", F.lit(False)) | F.coalesce(F.col("s.kind") == "CONSUMER", F.lit(False))
    outcome = F.when(paired, "completed").when(F.coalesce(client_peer, server_peer).isNotNull(), "virtual").otherwise("unpaired")
    connection = F.when(has_db, "database").when(messaging, "messaging_system").when(paired, "").otherwise("virtual_node")
    return rows.select(
        "trace_id", "key", outcome.alias("outcome"),
        F.coalesce("c.service", server_peer).alias("client"), F.coalesce("s.service", client_peer).alias("server"),
        connection.alias("connection_type"), F.when(paired, F.lit("")).when(F.col("c").isNull(), "client").otherwise("server").alias("virtual_node"),
        (F.coalesce("c.failed", F.lit(False)) | F.coalesce("s.failed", F.lit(False))).alias("failed"),
        F.col("c.ns").alias("client_ns"), F.col("s.ns").alias("server_ns"),
    )


def edge_metrics(pairs: DataFrame, bounds: tuple[float, ...] = EDGE_BOUNDS) -> DataFrame:
    """Requests, failures (0 included) and a duration histogram of each observed side, for each edge between services."""
    edges = pairs.filter("outcome <> 'unpaired'")
    side = lambda s: bucket_counts(F.col(f"{s}_ns") / 1e9, bounds, F.col(f"{s}_ns").isNotNull()).alias(f"{s}_buckets")
    return edges.groupBy("client", "server", "connection_type", "virtual_node").agg(
        F.count("*").alias("requests"), F.count_if("failed").alias("failed"),
        F.count("client_ns").alias("client_count"), F.coalesce(F.sum("client_ns"), F.lit(0)).alias("client_ns"), side("client"),
        F.count("server_ns").alias("server_count"), F.coalesce(F.sum("server_ns"), F.lit(0)).alias("server_ns"), side("server"),
    )


def outcomes(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of pairing outcomes, and of halves without a key."""
    return pairs.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(halves(spans).filter("unkeyable").select(F.lit("unkeyable").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")))
