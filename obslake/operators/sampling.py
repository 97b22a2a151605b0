"""Head and tail sampling of traces.

All spans of a trace share one fate: a hash of the trace id decides shares, and the tail policies see one aggregated row for each
trace. Policies give 'sample', 'veto' or null (no opinion); the first with an opinion decides, and no opinion at all drops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .folds import token_bucket

HASH_BITS = 60


def trace_hash(trace_id: Column | str = "trace_id") -> Column:
    """The top 60 bits of the id's MD5 as a long: the same number in any engine, so that samplers nest."""
    return F.conv(F.substring(F.md5(trace_id), 1, 15), 16, 10).cast("long")


def threshold(share: float) -> int:
    """Hashes below this are kept; 1 keeps all."""
    if not 0 <= share <= 1:
        raise ValueError(f"not a share: {share}")
    return round(share * (1 << HASH_BITS))


def head_sample(spans: DataFrame, share: float, keep_errors: bool = True, keep_slower_than_ns: int = 0) -> DataFrame:
    """Spans of the traces that the share keeps, and errors and slow spans besides. Works on streams."""
    keep = trace_hash() < threshold(share)
    if keep_errors:
        keep = keep | (F.col("status") == "ERROR")
    if keep_slower_than_ns:
        keep = keep | (F.col("end_ns") - F.col("start_ns") >= keep_slower_than_ns)
    return spans.filter(keep)


def rate_budget(rows: DataFrame, rate: float, second: Column, order: list[str], size: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with `admitted`: within each second (and key), in order, for as long as the rate isn't used up.

    The row that uses it up may go beyond: a debt that ends with the second, so a row larger than the rate isn't shut out
    for ever. Refused rows are charged nothing.
    """
    return rows.withColumn("admitted", _spent(Window.partitionBy(*keys, second).orderBy(*order), size if size is not None else F.lit(1)) < rate)


def _spent(w: WindowSpec, size: Column) -> Column:
    """What the rows before this one sum up to."""
    return F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rate_limiting(traces: DataFrame, rate: float, keys: tuple[str, ...] = (), at_ms: str = "first_ms") -> DataFrame:
    """traces (trace_id, n_spans, and when they are decided) with `admitted` by a bucket of `rate` spans a second, exactly: see folds.token_bucket().

    keys: what has a bucket of its own, such as the collector that decides. A trace larger than the bucket is admitted by a full one and leaves a debt.
    """
    own = traces.columns
    out = token_bucket(traces.withColumn("_us", F.col(at_ms) * 1000), rate, "_us", ["trace_id"], F.col("n_spans"), keys)
    return out.select(*own, "admitted")


def span_rate_limit(spans: DataFrame, rate: float, at_us: str, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Spans that a bucket of `rate` a second lets through, one by one."""
    return token_bucket(spans, rate, at_us, order, keys=keys).filter("admitted").drop("admitted")


@dataclass(frozen=True)
class Policy:
    """A named policy: votes, each an aggregate function that ignores nulls and what it gets of a span, and the verdict from the votes' columns."""

    name: str
    votes: dict[str, tuple[Callable[[Column], Column], Column]]
    verdict: Callable[[str], Column]

    @property
    def aggregates(self) -> dict[str, Column]:
        """The votes as aggregates over a trace's spans."""
        return {a: f(c) for a, (f, c) in self.votes.items()}


def _when(condition: Column, verdict: str = "sample") -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), verdict)


def _value(key: str | Column) -> Column:
    """A span's attribute, else its resource's; or the column of a table that has one for the attribute, which costs no look-ups in maps."""
    if isinstance(key, Column):
        return key
    return F.when(F.map_contains_key("attrs", key), F.col("attrs")[key]).otherwise(F.col("resource")[key])


def latency(name: str, at_least_ns: int, at_most_ns: int | None = None) -> Policy:
    """By the time from the first start to the last end; spans without a start don't count, ends before starts count as starts."""
    ok = F.col("start_ns") != 0
    used = {"first": (F.min, F.when(ok, F.col("start_ns"))), "last": (F.max, F.when(ok, F.greatest("start_ns", "end_ns")))}

    def verdict(p: str) -> Column:
        took = F.col(f"{p}last") - F.col(f"{p}first")
        return _when((took >= at_least_ns) & (took <= at_most_ns if at_most_ns is not None else F.lit(True)))

    return Policy(name, used, verdict)


def status_code(name: str, codes: list[str]) -> Policy:
    return Policy(name, {"hit": (F.bool_or, F.col("status").isin(codes))}, lambda p: _when(F.col(f"{p}hit")))


def string_attribute(name: str, key: str | Column, values: list[str] = (), patterns: list[str] = (), invert: bool = False) -> Policy:
    """A span whose attribute (or resource's) is a value or matches a pattern; inverted, a match is a veto."""
    hit = _value(key).isin(list(values))
    for p in patterns:
        hit = hit | _value(key).rlike(p)
    return Policy(name, {"hit": (F.bool_or, F.coalesce(hit, F.lit(False)))}, lambda p: _when(F.col(f"{p}hit"), "veto" if invert else "sample"))


def numeric_attribute(name: str, key: str | Column, low: float, high: float) -> Policy:
    return Policy(name, {"hit": (F.bool_or, F.coalesce(_value(key).try_cast("double").between(low, high), F.lit(False)))}, lambda p: _when(F.col(f"{p}hit")))


def boolean_attribute(name: str, key: str | Column, value: bool) -> Policy:
    return Policy(name, {"hit": (F.bool_or, F.coalesce(_value(key) == str(value).lower(), F.lit(False)))}, lambda p: _when(F.col(f"{p}hit")))


def probabilistic(name: str, percent: float) -> Policy:
    return Policy(name, {}, lambda p: _when(trace_hash() < threshold(percent / 100)))


def always(name: str) -> Policy:
    return Policy(name, {}, lambda p: F.lit("sample"))


def all_of(name: str, parts: list[Policy]) -> Policy:
    """Samples if all parts do; the first part that doesn't ends it, and its veto counts."""

    def verdict(p: str) -> Column:
        out = F.lit("sample")
        for k, part in reversed(list(enumerate(parts))):
            own = part.verdict(f"{p}{k}_")
            out = F.when(own == "sample", out).when(own == "veto", "veto")
        return out

    return Policy(name, {f"{k}_{a}": c for k, part in enumerate(parts) for a, c in part.votes.items()}, verdict)


def _cast(spans: DataFrame, policies: list[Policy], own: list[str], wait_ms: int | None, most_spans: int | None) -> DataFrame:
    """Columns of spans (or "*"), what each span gives to the policies' votes (`_p0_hit`), and `_votes`: whether it has a vote.

    What it gives is taken before the shuffle, so that the columns that only votes read (maps of attributes above all) don't travel.
    """
    order = ["arrival_ms", "span_id", "start_ns", "end_ns"] if most_spans is not None else ["arrival_ms"] if wait_ms is not None else []
    given = [c.alias(f"_p{k}_{a}") for k, p in enumerate(policies) for a, (_, c) in p.votes.items()]
    out = spans.select(*own, *(c for c in order if c not in own and "*" not in own), *given)
    votes, w = F.lit(True), Window.partitionBy("trace_id")
    if wait_ms is not None:
        out = out.withColumn("_first", F.min("arrival_ms").over(w))
        votes = votes & F.coalesce(F.col("arrival_ms") < F.col("_first") + wait_ms, F.lit(False))
    if most_spans is not None:
        out = out.withColumn("_nth", F.row_number().over(w.orderBy(*order)))
        votes = votes & (F.col("_nth") <= most_spans)
    return out.withColumn("_votes", votes)


def summaries(spans: DataFrame, policies: list[Policy], wait_ms: int | None = None, most_spans: int | None = None) -> DataFrame:
    """One row for each trace with everything that the policies ask for, in one aggregation.

    wait_ms: only spans that arrive before the first arrival plus this have a vote; most_spans: nor those past so many.
    """
    voting = _cast(spans, policies, ["trace_id", "arrival_ms"], wait_ms, most_spans).filter("_votes")
    asked = [f(F.col(f"_p{k}_{a}")).alias(f"p{k}_{a}") for k, p in enumerate(policies) for a, (f, _) in p.votes.items()]
    return voting.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.min("arrival_ms").alias("first_ms"), *asked)


def decide(spans: DataFrame, policies: list[Policy], wait_ms: int | None = None, most_spans: int | None = None) -> DataFrame:
    """(trace_id, n_spans, first_ms, policy, verdict): the first policy with an opinion; none: 'drop'."""
    traces = summaries(spans, policies, wait_ms, most_spans)
    opinions = [F.when(p.verdict(f"p{k}_").isNotNull(), F.struct(F.lit(p.name).alias("policy"), p.verdict(f"p{k}_").alias("verdict"))) for k, p in enumerate(policies)]
    first = F.coalesce(*opinions, F.struct(F.lit("").alias("policy"), F.lit("drop").alias("verdict")))
    return traces.select("trace_id", "n_spans", "first_ms", first.alias("d")).select("trace_id", "n_spans", "first_ms", "d.policy", "d.verdict")


def kept_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans of the sampled traces; keep() has them sooner where the decisions are those of the same spans."""
    return spans.join(decisions.filter("verdict = 'sample'").select("trace_id"), "trace_id", "left_semi")


def keep(spans: DataFrame, policies: list[Policy], wait_ms: int | None = None, most_spans: int | None = None) -> DataFrame:
    """kept_spans() of decide() in one shuffle: a trace's spans stay where its votes are counted, so no join has to bring both together again."""
    w = Window.partitionBy("trace_id")
    cast = _cast(spans.filter("trace_id is not null"), policies, ["*"], wait_ms, most_spans)
    counted = {f"_c{k}_{a}": f(F.when(F.col("_votes"), F.col(f"_p{k}_{a}"))).over(w) for k, p in enumerate(policies) for a, (f, _) in p.votes.items()}
    first = F.coalesce(*(p.verdict(f"_c{k}_") for k, p in enumerate(policies)), F.lit("drop"))
    out = cast.withColumns({**counted, "_any": F.bool_or("_votes").over(w)}).filter(F.col("_any") & (first == "sample"))
    return out.drop(*(c for c in out.columns if c not in spans.columns))


def composite(traces: DataFrame, policies: list[Policy], shares: dict[str, float], total_rate: float) -> DataFrame:
    """(trace_id, n_spans, first_ms, policy, verdict) of summaries() under policies with a rate each.

    A policy's rate is its share (percent) of the total; what the shares leave is split evenly among the policies without one. The
    policies are asked in order: the first that samples the trace and has budget left in the second of its first arrival decides, charged with
    all its spans (rate_budget()'s rule). One without budget leaves the trace to the next; a veto decides at once; nobody: 'drop'.
    """
    names = [p.name for p in policies]
    rest = [n for n in names if n not in shares]
    left = 100 - sum(shares.values())
    if left < 0 or set(shares) - set(names) or rest and left == 0:
        raise ValueError("shares exceed 100 percent, leave nothing for a policy without one, or name none")
    second = Window.partitionBy(F.floor(F.col("first_ms") / 1000)).orderBy("first_ms", "trace_id")
    out = traces.withColumns({f"_v{k}": p.verdict(f"p{k}_") for k, p in enumerate(policies)})
    out = out.select("trace_id", "n_spans", "first_ms", *(f"_v{k}" for k in range(len(names)))).withColumn("_by", F.lit(None).cast("int"))
    for k, name in enumerate(names):
        verdict, rate = F.col(f"_v{k}"), total_rate * shares.get(name, left / max(1, len(rest))) / 100
        out = out.withColumn("_wants", F.col("_by").isNull() & F.coalesce(verdict == "sample", F.lit(False)))
        fits = F.col("_wants") & (_spent(second, F.when(F.col("_wants"), F.col("n_spans"))) < rate)
        out = out.withColumn("_by", F.coalesce("_by", F.when(fits | (verdict == "veto"), k)))
    by = F.col("_by")
    return out.select("trace_id", "n_spans", "first_ms", F.coalesce(F.get(F.array(*map(F.lit, names)), by), F.lit("")).alias("policy"), F.coalesce(F.get(F.array(*(f"_v{k}" for k in range(len(names)))), by), F.lit("drop")).alias("verdict"))


def late_spans(spans: DataFrame, decisions: DataFrame, wait_ms: int, ttl_ms: int) -> DataFrame:
    """Spans that arrive after their trace's decision with fate: the verdict within ttl_ms of it, else 'fresh'."""
    known = decisions.select("trace_id", F.col("first_ms").alias("_first"), "verdict")
    late = spans.join(known, "trace_id").filter(F.col("arrival_ms") >= F.col("_first") + wait_ms)
    return late.withColumn("fate", F.when(F.col("arrival_ms") < F.col("_first") + wait_ms + ttl_ms, F.col("verdict")).otherwise("fresh")).drop("_first", "verdict")


def policy_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("policy", "verdict").agg(F.count("*").alias("traces"), F.sum("n_spans").alias("spans"))
