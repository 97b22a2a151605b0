"""Mixing sources to target weights through a domain-language-source tree.

The token budget flows down the tree. At each node it is shared among the children by weight, and no child gets more than
the leaves under it can give (their tokens times the epochs allowed): what a child can't take goes to its siblings by
weight, and because a node's own capacity is the sum of its children's, only what all of them can't take has been
passed to the node's siblings, and so on up. A leaf's quota is whole epochs and a prefix of one more, taken in an order that the
seed and the epoch's number give.

Only DataFrame functions. Counts are pre-aggregated per leaf. A prefix is found without sorting a leaf in one task: the
order is cut into 4096 ranges of its hash, token sums per range give the one range in which the prefix ends, and only that range's
rows are sorted. All amounts are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

TREE = ("domain", "lang", "source")
NONE = "none"
_RANGE_BITS = 48


def domain_of(source: Column | str) -> Column:
    """The domain of the queries: sources numbered alike modulo four belong together."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), number.cast("int") % 4)).otherwise(NONE)


def _weight(names: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(names == name, w).otherwise(out)
    return out


def shared_out(children: DataFrame, parent: list[str], name: str, budget: str = "budget", capacity: str = "capacity", weight: str = "weight", out: str = "got") -> DataFrame:
    """children with column `out`: the parent's budget by weight, capped by capacity, the excess given to the others again.

    In the order of capacity for a unit of weight the full children come first; the rest share what is left by weight,
    rounded down. Weight 0 gets nothing.
    """
    w = F.col(weight).cast("decimal(18,0)")
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("_ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*(parent or [F.lit(0)]))
    x = children.withColumn("_ratio", ratio)
    x = x.withColumn("_left", F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))).withColumn("_weights", F.sum(weight).over(onward))
    x = x.withColumn("_full", (F.col(weight) > 0) & (F.col("_left").cast("decimal(20,0)") * w >= F.col(capacity).cast("decimal(20,0)") * F.col("_weights").cast("decimal(18,0)")))
    x = x.withColumn("_left", F.col(budget) - F.sum(F.when(F.col("_full"), F.col(capacity)).otherwise(0)).over(whole))
    x = x.withColumn("_weights", F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(whole))
    share = F.expr(f"cast(_left as decimal(20,0)) * cast({weight} as decimal(18,0)) div cast(_weights as decimal(18,0))")
    got = F.when(F.col("_full"), F.col(capacity)).when((F.col("_weights") > 0) & (F.col(weight) > 0), share).otherwise(0)
    return x.withColumn(out, got.cast("long")).drop("_ratio", "_left", "_weights", "_full")


def leaf_quotas(leaves: DataFrame, budget_share: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with quota; the budget is a share of all tokens, rounded down."""
    leaves, level = leaves.withColumn("capacity", F.col("tokens") * epochs), None
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    for depth in range(len(TREE)):
        keys = list(TREE[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(F.col(TREE[depth]), weights.get(TREE[depth], {})).cast("long"))
        nodes = nodes.join(level, keys[:-1]) if level is not None else nodes.withColumn("budget", F.floor(whole * F.lit(budget_share)).cast("long"))
        level = shared_out(nodes, keys[:-1], TREE[depth]).select(*keys, "tokens", F.col("got").alias("budget"))
        level = level if depth == len(TREE) - 1 else level.drop("tokens")
    return level.withColumnRenamed("budget", "quota")


def order_key(seed: int, epoch: Column, doc_id: Column | str, text: Column | str) -> Column:
    """A 60-bit number that orders a leaf's rows in an epoch: of the doc_id, or of the text where that is null."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), own)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, budget_share: float, epochs: int = 2, seed: int = 17, weights: dict[str, dict[str, int]] | None = None, domain: Column | None = None) -> DataFrame:
    """(doc_id long, domain, lang, source string, n_tokens long, copies long) of the rows that the mix takes.

    Tokens are words. The budget is budget_share of all tokens, rounded down. copies is the number of epochs that take the
    row: a prefix holds the rows, in the epoch's order (ties by doc_id, then tokens), whose running total stays within what
    the quota leaves after whole epochs. Null domain, lang or source: "none", a name like any other; null text: no token.
    Leaves without tokens give their rows only as parts of whole epochs, of which they have none. Very long texts count whole, and may be
    longer than what is left of a quota: then they aren't taken. Other columns are not read. No rows: an empty result.
    """
    return _mixed(docs, [], budget_share, epochs, seed, weights, domain).select("doc_id", *TREE, "n_tokens", "copies")


def _mixed(docs: DataFrame, carried: list[Column], budget_share: float, epochs: int, seed: int, weights: dict[str, dict[str, int]] | None, domain: Column | None) -> DataFrame:
    """mix() with more columns carried along."""
    leaf = list(TREE)
    named = {"domain": domain if domain is not None else domain_of("source"), "lang": F.col("lang"), "source": F.col("source")}
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = F.when(F.col("doc_id").isNull(), F.col("text"))  # only these rows are ordered by their text
    base = docs.select(F.col("doc_id").cast("long"), *(F.coalesce(c, F.lit(NONE)).alias(n) for n, c in named.items()), n_tokens.alias("n_tokens"), own.alias("own_text"), *carried)
    base = stored(base, "tokens")
    # a handful of rows that the rest asks for several times
    leaves = stored(base.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).coalesce(1), "leaves")
    quotas = leaf_quotas(leaves, budget_share, epochs, weights or {})
    quotas = stored(quotas.filter("tokens > 0").select(*leaf, F.expr("quota div tokens").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest")).coalesce(1), "quotas")
    rows = base.join(quotas, leaf).withColumn("key", order_key(seed, F.col("whole"), "doc_id", "own_text")).withColumn("range", F.shiftright("key", _RANGE_BITS))
    ranges = rows.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("range_tokens"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("ends", F.sum("range_tokens").over(running)).withColumn("starts", F.col("ends") - F.col("range_tokens"))
    placed = rows.join(ranges.select(*leaf, "range", "starts", "ends"), [*leaf, "range"])
    cut = (F.col("starts") <= F.col("rest")) & (F.col("ends") > F.col("rest"))
    sure = placed.filter(~cut).withColumn("taken", (F.col("ends") <= F.col("rest")).cast("long"))
    inside = Window.partitionBy(*leaf, "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(cut).withColumn("taken", (F.col("starts") + F.sum("n_tokens").over(inside) <= F.col("rest")).cast("long"))
    out = sure.unionByName(edge).withColumn("copies", F.col("whole") + F.col("taken"))
    return out.filter("copies > 0")


def mixed_rows(docs: DataFrame, budget_share: float, epochs: int = 2, seed: int = 17, weights: dict[str, dict[str, int]] | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of docs that mix() takes, each as often as it says, with all their columns whatever these are named.

    A row is taken for itself: rows that share a doc_id, or have none, are told apart.
    """
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row")
    out = _mixed(docs, [whole], budget_share, epochs, seed, weights, domain)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")
    return out.select("row", again).select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
