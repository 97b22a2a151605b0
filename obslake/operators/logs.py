"""The log chain: redaction, lifted attributes, enrichment, rules, routing.

A record has body, attrs, resource, severity_text, severity_number, ts_us. All steps are column expressions, so a whole chain is one
projection over the input, in batch and on streams.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.scalars import glob_match, hex_id
from ..functions.selectors import BANDS, Record, field_of, match, parsed_line
from .folds import token_bucket

REDACTED = "[REDACTED]"
#: Parts of the names that secrets go by.
_SECRET_NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key|auth[_-]?token"


@dataclass(frozen=True)
class Redaction:
    """A pattern, its replacement, and lower-case words of which a line must hold one for the pattern to match (none: any line may match).

    more: further patterns and replacements, which follow in order. marks: for each of all forms what any match of it holds and no replacement brings in (empty: nothing).
    """

    name: str
    pattern: str
    replacement: str = REDACTED
    words: tuple[str, ...] = ()
    more: tuple[tuple[str, str], ...] = ()
    marks: tuple[str, ...] = ()

    @property
    def forms(self) -> tuple[tuple[str, str], ...]:
        return ((self.pattern, self.replacement), *self.more)


def _credentials(scheme: str, token: str) -> str:
    """Scheme and blanks in group 1, then what RFC 9110 calls token68, in the form that the scheme has."""
    return rf"(?i)\b({scheme}[ \t]+){token}"


def _card(*groups: str) -> str:
    return r"\b" + "[ -]?".join(groups) + r"\b"


def _assigned(value: str) -> str:
    """A secret's name, quoted or not, and a colon, equals sign or arrow in group 1, then a value."""
    return rf"(?i)((?:{_SECRET_NAMES})(?:\\?[\"'])?[ \t]*(?:=>|[:=])[ \t]*){value}"


#: Values: a string of RFC 8259, perhaps cut off; a single-quoted word of a POSIX shell; and a bare one of RFC 3986's characters and letters, less what separates fields.
_JSON_STRING, _SHELL_WORD, _BARE = r'"(?:[^"\\]|\\.)+("|$)', r"'[^']+('|$)", r"[\p{L}\p{N}._~%+/=!$*@:#?^|<>-]+"

#: Labels of private keys in textual envelopes (RFC 7468, RFC 5915, PKCS #1, OpenSSH).
_KEY_LABELS = ("PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "EC PRIVATE KEY", "RSA PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY")


def _envelope(label: str) -> str:
    """A begin line, any lines of base64 or of headers (what was redacted in them before, too), and the end line of that label if it follows.

    Lines end as they are or as escapes, or are put on one line. Where the end is cut off, the envelope goes as far as such lines do.
    """
    gap = r"(?:[ \t\r\n]|\\[rn])+"
    line = r"(?:[A-Za-z][A-Za-z-]*: [^\r\n\\]+|(?:[A-Za-z\d+/=]|\[REDACTED\])+)"
    return f"-----BEGIN {label}-----(?:{gap}{line})*(?:{gap}-----END {label}-----)?"


#: By name (fixed values: configurations use them). The forms: RFC 6750 tokens, RFC 7617 base64 in fours, name and value pairs with JSON or
#: shell quoting, access key ids (four letters, sixteen more), RFC 7468 envelopes, the password in RFC 3986 user information, RFC 5321 mailboxes
#: with a dotted domain, ISO 7812 numbers as 13 to 19 digits in fours or as 4-6-5.
BUILT_IN = {
    r.name: r
    for r in (
        Redaction("bearer", _credentials("bearer", r"[\w+./~-]+={0,2}"), f"$1{REDACTED}", ("bearer",)),
        Redaction("basic-auth", _credentials("basic", r"(?:[a-z\d+/]{4}){2,}(?:[a-z\d+/]{2}==|[a-z\d+/]{3}=|\b)"), f"$1{REDACTED}", ("basic",)),
        Redaction("secret-kv", _assigned(_JSON_STRING), f'$1"{REDACTED}$2', ("pass", "pwd", "secret", "token", "key"), ((_assigned(_SHELL_WORD), f"$1'{REDACTED}$2"), (_assigned(_BARE), f"$1{REDACTED}")), ('"', "'")),
        Redaction("aws-key", r"\bA[KS]IA[A-Z\d]{16}\b", REDACTED, ("akia", "asia")),
        Redaction("private-key", "|".join(_envelope(x) for x in _KEY_LABELS), REDACTED, ("private key",)),
        Redaction("url-userinfo", r"([A-Za-z][\w+.-]*://[^\s/?#:@\"'<>]*:)[^\s/?#\"'<>,;]+@", f"$1{REDACTED}@", ("://",)),
        Redaction("email", r"\b[\w.%+'-]+@(?:[A-Za-z\d-]+\.)+[A-Za-z]{2,}\b", REDACTED, ("@",)),
        Redaction("credit-card", rf"{_card(r'3[47][0-9]{2}', '[0-9]{6}', '[0-9]{5}')}|{_card('[0-9]{4}', '[0-9]{4}', '[0-9]{4}', '[0-9]{1,4}(?:[ -]?[0-9]{1,3})?')}"),
    )
}
DEFAULTS = ("bearer", "basic-auth", "secret-kv", "aws-key", "private-key", "url-userinfo")


def redactions(names: list[str], own: list[Redaction] = ()) -> list[Redaction]:
    """Built-in redactions in the order given ('defaults' stands for the usual six), then one's own; unknown names fail."""
    out: list[Redaction] = []
    for n in names:
        for name in DEFAULTS if n == "defaults" else (n,):
            if name not in BUILT_IN:
                raise ValueError(f"unknown redaction: {name}")
            out.append(BUILT_IN[name])
    for r in own:
        re.compile(r.pattern)
    return [*out, *own]


def scrub(text: Column, steps: list[Redaction]) -> Column:
    """text after all redactions in order; each runs only on lines that hold one of its words."""

    def redacted(line: Column, low: Column) -> Column:
        # one-element arrays: what came out of a step is named once, so that steps don't multiply
        now = F.array(line)
        for s in steps:
            some = F.lit(not s.words)
            for w in s.words:
                some = some | low.contains(w)

            def step(x: Column, s: Redaction = s, some: Column = some) -> Column:
                done = x
                for (pattern, replacement), mark in zip_longest(s.forms, s.marks):
                    new = F.regexp_replace(done, pattern, replacement)
                    done = F.when(x.contains(mark), new).otherwise(done) if mark else new
                return F.when(some, done).otherwise(x)

            now = F.transform(now, _one(step))
        return now[0]

    if not steps:
        return text
    return F.transform(F.array(text), lambda t: F.transform(F.array(F.lower(t)), lambda low: redacted(t, low))[0])[0]


def _one(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """step as a function of one parameter."""
    return lambda x: step(x)


def scrub_counts(logs: DataFrame, steps: list[Redaction]) -> DataFrame:
    """(name, n): records that each redaction changes, in order."""
    out = logs.select(F.col("body").alias("_0"))
    for k, s in enumerate(steps):
        out = out.withColumn(f"_{k + 1}", scrub(F.col(f"_{k}"), [s]))
    counts = F.array(*(F.struct(F.lit(s.name).alias("name"), (F.col(f"_{k}") != F.col(f"_{k + 1}")).cast("long").alias("hit")) for k, s in enumerate(steps)))
    return out.select(F.inline(counts)).groupBy("name").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n"))


def scrub_named(key: Column, value: Column, steps: list[Redaction]) -> Column:
    """value scrubbed as key=value, without the key again if it is still there."""
    prefix = F.concat(key, F.lit("="))
    bare = lambda t: F.when(t.startswith(prefix), F.substring(t, F.length(prefix) + 1, F.length(t))).otherwise(t)
    return F.transform(F.array(scrub(F.concat(prefix, value), steps)), bare)[0]


def scrub_structured(body: Column, steps: list[Redaction]) -> Column:
    """A map body with every value scrubbed, alone and as key=value."""

    def leaf(k: Column, v: Column) -> Column:
        def judged(alone: Column) -> Column:
            return F.when(alone != v, alone).otherwise(scrub_named(k, v, steps))

        return F.transform(F.array(scrub(v, steps)), judged)[0]

    return F.transform_values(body, leaf)


@dataclass(frozen=True)
class Lift:
    """A field of the line that becomes an attribute of the log record, its scope or its resource."""

    field: str
    attribute: str
    target: str = "log"


def lifted(body: Column, rules: list[Lift], target: str, fields: Column | None = None) -> Column:
    """Map of the attributes that the rules for a target find; nothing and null are left out."""
    own = [r for r in rules if r.target == target]
    if not own:
        return maps.empty()
    fields = parsed_line(body) if fields is None else fields
    return F.map_filter(F.create_map(*(x for r in own for x in (F.lit(r.attribute), field_of(fields, r.field)))), lambda k, v: v.isNotNull())


def lift_attributes(logs: DataFrame, rules: list[Lift]) -> DataFrame:
    """logs with the lifted fields in attrs, scope_attrs (if asked for) and resource; the line's values win."""
    staged = with_fields(logs)
    fields = F.col(FIELDS)
    targets, out = {r.target for r in rules}, {}
    for name, target in (("attrs", "log"), ("resource", "resource")):
        if target in targets:
            out[name] = maps.merged(F.col(name), lifted(F.col("body"), rules, target, fields))
    if "scope" in targets:
        out["scope_attrs"] = lifted(F.col("body"), rules, "scope", fields)
    out = staged.withColumns(out)
    return out if FIELDS in logs.columns else out.drop(FIELDS)


#: Column that holds parsed_line() of the body inside the chain.
FIELDS = "_fields"


def with_fields(logs: DataFrame) -> DataFrame:
    """logs with the body parsed once, unless it is already."""
    return logs if FIELDS in logs.columns else settled(logs.withColumn(FIELDS, parsed_line(F.col("body"))))


def settled(df: DataFrame) -> DataFrame:
    """df behind a generator of one row: the optimizer moves neither projections nor predicates across, so what a column
    cost is paid once, however often later steps use it."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


#: Spellings of the fields that enrichment looks for.
SPELLINGS = {
    "severity": ("level", "severity", "lvl", "@l"),
    "time": ("time", "timestamp", "ts", "@t"),
    "trace_id": ("trace_id", "traceId", "traceid", "request_id"),
    "span_id": ("span_id", "spanId", "spanid"),
    "log.template": ("@mt", "message_template"),
    "log.source_context": ("SourceContext", "logger"),
    "exception.type": ("exception_type", "exceptionType"),
    "exception.message": ("exception_message", "exceptionMessage"),
    "exception.stacktrace": ("stacktrace", "stack_trace", "@x"),
}
#: Names of severities in lines, by band.
SEVERITIES = {"trace": ("trace", "verbose", "v"), "debug": ("debug", "dbg", "d"), "info": ("info", "information", "i", "notice"), "warn": ("warn", "warning", "w", "wrn"), "error": ("error", "err", "e"), "fatal": ("fatal", "critical", "crit", "panic", "f")}


def enriched_format(body: Column, fields: Column | None = None) -> Column:
    """How a line is understood: json, logfmt, pattern or none."""
    fields = parsed_line(body) if fields is None else fields
    known = F.arrays_overlap(fields["keys"], F.array(*map(F.lit, ("level", "severity", "lvl", "msg", "ts", "time"))))
    return F.when(fields["json"].isNotNull(), "json").when(known, "logfmt").when(body.rlike(_PATTERN), "pattern").otherwise("none")


_PATTERN = r"^(?:([IWEF])\d{4} \d\d:\d\d:\d\d\.\d+|\[?(?i:(trace|debug|info|warn(?:ing)?|error|fatal))\]?[:\s])"


def _named(fields: Column, name: str) -> Column:
    """The first spelling that the line has."""
    return F.coalesce(*(F.nullif(field_of(fields, s, dotted=False), F.lit("")) for s in SPELLINGS[name]))


def line_time(text: Column) -> Column:
    """Struct ts_us, zoned of an ISO 8601 time; one without zone is read as UTC."""
    zoned = text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$")
    ts = F.unix_micros(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))
    return F.struct(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), ts).alias("ts_us"), zoned.alias("zoned"))


def _band(word: Column) -> Column:
    low, out = F.lower(word), F.lit(None).cast("string")
    for band, words in SEVERITIES.items():
        out = F.when(low.isin(*words), band).otherwise(out)
    return out


def may_replace_timestamp(parsed: Column, has_zone: Column, ts: Column) -> Column:
    """A parsed time takes the record's place only if it says its zone, or the record has none."""
    return F.when(parsed.isNotNull() & (has_zone | ts.isNull()), parsed).otherwise(ts)


def enrich_lines(logs: DataFrame, overwrite: bool = False) -> DataFrame:
    """logs with severity, time, trace and span id and the known attributes that the line tells; without overwrite only what is unset.

    A template gets log.template_hash besides. Adds column format, and time_rejected where there is a ts_us: the line's time was
    not taken because it doesn't say its zone.
    """
    body, fields = F.col("body"), F.col(FIELDS)
    short = F.regexp_extract(body, _PATTERN, 1)
    word = F.coalesce(_named(fields, "severity"), F.nullif(F.coalesce(F.nullif(short, F.lit("")), F.regexp_extract(body, _PATTERN, 2)), F.lit("")))
    pick = lambda new, old: F.coalesce(new, old) if overwrite else F.coalesce(F.nullif(old, F.lit("")), new, old)
    # in steps, so that no expression stands in several others
    names = [n for n in SPELLINGS if "." in n]
    staged = with_fields(logs).withColumns({"_word": word, "_said": _named(fields, "time")} | {f"_{k}": _named(fields, n) for k, n in enumerate(names)})
    staged = settled(settled(staged).withColumns({"_band": _band(F.col("_word")), "_time": line_time(F.col("_said"))}))
    number = F.coalesce(*(F.when(F.col("_band") == b, 4 * k + 1) for k, b in enumerate(BANDS)))
    hashed = F.substring(F.md5(F.col(f"_{names.index('log.template')}")), 1, 16)
    found = maps.non_empty(F.create_map(F.lit("log.template_hash"), hashed, *(x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"_{k}")))))
    unset = F.coalesce("severity_text", F.lit("")) == ""
    out = {
        "format": enriched_format(body, fields),
        "severity_number": F.when(number.isNotNull() & (F.lit(overwrite) | unset), number).otherwise(F.col("severity_number")),
        "severity_text": pick(F.col("_band"), F.col("severity_text")),
        "attrs": maps.merged(F.col("attrs"), found) if overwrite else maps.merged(found, F.col("attrs")),
    }
    if "ts_us" in logs.columns:
        ts, said = F.col("ts_us"), F.col("_time")["ts_us"]
        open_ = F.lit(True) if overwrite else ts.isNull()
        out["time_rejected"] = F.coalesce(open_ & said.isNotNull() & ~F.col("_time")["zoned"] & ts.isNotNull(), F.lit(False))
        out["ts_us"] = F.when(open_, may_replace_timestamp(said, F.col("_time")["zoned"], ts)).otherwise(ts)
    for name, length in (("trace_id", 32), ("span_id", 16)):
        new = hex_id(_named(fields, name), length)
        out[name] = pick(new, F.col(name)) if name in logs.columns else new
    done = settled(staged.withColumns(out).drop("_word", "_said", "_band", "_time", *(f"_{k}" for k in range(len(names)))))
    return done if FIELDS in logs.columns else done.drop(FIELDS)


@dataclass(frozen=True)
class Rule:
    """Keep or drop what matches; keep may sample one in round(1/share)."""

    action: str
    exact: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    share: float = 1.0

    def __post_init__(self) -> None:
        if self.action not in ("keep", "drop"):
            raise ValueError(f"unknown action: {self.action}")
        if not 0 < self.share <= 1:
            raise ValueError("a share lies above 0 and at most at 1")


def rule_index(rules: list[Rule], record: Record | None = None) -> Column:
    """Number of the first rule that matches, null if none does."""
    record = record or Record.default()
    return F.coalesce(*(F.when(match(record, list(r.exact), list(r.regex)), k) for k, r in enumerate(rules)), F.lit(None).cast("int"))


def line_rules(logs: DataFrame, rules: list[Rule], order: list[str], source: list[str] = ()) -> DataFrame:
    """The records that the first matching rule keeps; what no rule matches stays.

    A sampling rule keeps the first of each N that it matches, in the given order for each source. Only the records that
    such a rule matches are ordered; without one there is no shuffle. Use stable_line_rules() on streams.
    """
    fields = FIELDS if FIELDS in logs.columns else None
    hit = settled(logs.withColumn("_rule", rule_index(rules, Record.default(fields))))
    steps = {k: round(1 / r.share) for k, r in enumerate(rules) if r.action == "keep" and r.share < 1}
    dropped = [k for k, r in enumerate(rules) if r.action == "drop"]
    keep = F.coalesce(~F.col("_rule").isin(dropped + list(steps)), F.lit(True)) if dropped or steps else F.lit(True)
    out = hit.filter(keep).drop("_rule")
    if steps:
        w = Window.partitionBy("_rule", *source).orderBy(*order)
        every = F.coalesce(*(F.when(F.col("_rule") == k, n) for k, n in steps.items()))
        some = hit.filter(F.col("_rule").isin(list(steps))).withColumn("_nth", F.row_number().over(w) - 1)
        out = out.unionByName(some.filter(F.col("_nth") % every == 0).drop("_rule", "_nth"))
    return out


def stable_line_rules(logs: DataFrame, rules: list[Rule], identity: list[str]) -> DataFrame:
    """line_rules() without order: one in N by a hash of the record's identity. Works on streams."""
    keep = F.lit(True)
    index = rule_index(rules, Record.default(FIELDS if FIELDS in logs.columns else None))
    for k, r in enumerate(rules):
        own = F.lit(False) if r.action == "drop" else F.pmod(F.xxhash64(*identity), F.lit(round(1 / r.share))) == 0
        keep = F.when(index == k, own).otherwise(keep)
    return logs.filter(keep)


#: Limits of the rules that a pod may bring along.
POD_RULES, POD_SELECTORS, POD_PATTERN = 16, 16, 512
_POD_SCHEMA = "exclude boolean, serviceName string, rules array<struct<action:string,match:string,regex:string>>"


def workload_rules(logs: DataFrame, pods: DataFrame) -> DataFrame:
    """logs without what their pod's own configuration drops, with its service name, if it gives one.

    pods: namespace, pod, config (JSON: exclude, serviceName, rules of action and `match` substring or `regex` over the body).
    The first matching rule decides. A configuration over the limits or that isn't JSON is ignored.
    """
    parsed = F.from_json("config", _POD_SCHEMA)
    sane = (F.coalesce(F.size(parsed["rules"]), F.lit(0)) <= POD_RULES) & ~F.coalesce(F.exists(parsed["rules"], lambda r: F.coalesce(F.length(r["regex"]), F.lit(0)) > POD_PATTERN), F.lit(False))
    own = pods.select(F.col("namespace"), F.col("pod"), F.when(sane, parsed).alias("_own"))
    joined = logs.join(own, ["namespace", "pod"], "left")
    hit = lambda r: F.coalesce(F.col("body").contains(r["match"]), F.lit(False)) | F.coalesce(F.regexp_like(F.col("body"), r["regex"]), F.lit(False))
    first = F.try_element_at(F.filter(F.col("_own.rules"), hit), F.lit(1))
    dropped = F.coalesce(F.col("_own.exclude"), F.lit(False)) | F.coalesce(first["action"] == "drop", F.lit(False))
    named = F.when(F.col("_own.serviceName").isNotNull(), maps.merged(F.col("resource"), F.create_map(F.lit("service.name"), F.col("_own.serviceName")))).otherwise(F.col("resource"))
    return joined.filter(~dropped).withColumn("resource", named).drop("_own")


def route(logs: DataFrame, routes: list[tuple[str, list[str]]], default: str = "default", marker: str | None = None) -> DataFrame:
    """logs with column route: the marker's if it names a route (an unknown one: default), else the first route with a glob that the namespace matches."""
    namespace = F.col("resource")["k8s.namespace.name"]
    out = F.lit(default)
    for name, globs in reversed(routes):
        hit = F.lit(False)
        for g in globs:
            hit = hit | glob_match(g, namespace)
        out = F.when(hit, name).otherwise(out)
    if marker:
        out = F.when(F.col(marker).isNull(), out).when(F.col(marker).isin([n for n, _ in routes]), F.col(marker)).otherwise(default)
    return logs.withColumn("route", out)


def strip_reserved(logs: DataFrame, resource_keys: list[str], element_keys: list[str]) -> DataFrame:
    """logs without keys that only the pipeline may set, and stripped: how many went."""
    gone = F.size(F.map_filter("resource", lambda k, v: k.isin(resource_keys))) + F.size(F.map_filter("attrs", lambda k, v: k.isin(element_keys)))
    return logs.withColumn("stripped", gone).withColumn("resource", maps.without(F.col("resource"), resource_keys)).withColumn("attrs", maps.without(F.col("attrs"), element_keys))


def rate_limit(logs: DataFrame, keys: list[str], rate: int, ts_us: str, order: list[str]) -> DataFrame:
    """The first `rate` records of each key and second."""
    w = Window.partitionBy(*keys, F.expr(f"{ts_us} div 1000000")).orderBy(*order)
    return logs.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= rate).drop("_nth")


def bucket_limit(logs: DataFrame, keys: list[str], rate: float, burst: float, ts_us: str, order: list[str]) -> DataFrame:
    """Records that a bucket of each key lets through: `burst` at once, `rate` a second in the long run (folds.token_bucket())."""
    return token_bucket(logs, rate, ts_us, order, keys=tuple(keys), burst=burst, debt=False).filter("admitted").drop("admitted")


def throttle(rows: DataFrame, keys: list[str], window_us: int, ts_us: str, order: list[str]) -> DataFrame:
    """The first row of each key and tumbling window; folds.throttle() has windows that begin with the row, and tables of bounded keys."""
    w = Window.partitionBy(*keys, F.expr(f"{ts_us} div {window_us}")).orderBy(ts_us, *order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: replayed events and re-read lines go. On streams set a watermark before."""
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


# --- putting lines together

_CRI = r"^(\S+) (stdout|stderr) ([PF])(?::\S+)? ?(.*)$"


def cri_lines(lines: DataFrame, keys: list[str], order: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Lines `time stream P|F text` of each container and stream, partial ones joined up to the next full one.

    Returns keys, stream, time of the first part, body, first and last order. A run of parts is also closed where it passes a multiple of twice
    max_bytes. What isn't in the format goes.
    """
    part = lines.filter(F.col("line").rlike(_CRI)).select(*keys, F.col(order).alias("_at"), *(F.regexp_extract("line", _CRI, k).alias(n) for k, n in enumerate(("time", "stream", "tag", "text"), 1)))
    w = Window.partitionBy(*keys, "stream").orderBy("_at")
    runs = part.withColumn("_run", F.coalesce(F.sum((F.col("tag") == "F").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(*keys, "stream", "_run").orderBy("_at")
    runs = runs.withColumn("_cut", F.floor((F.sum(F.octet_length("text")).over(own) - 1) / F.lit(2 * max_bytes)))
    parts = F.array_sort(F.collect_list(F.struct("_at", "time", "text")))
    out = runs.groupBy(*keys, "stream", "_run", "_cut").agg(parts.alias("p"))
    return out.select(*keys, "stream", F.col("p")[0]["time"].alias("time"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("body"), F.col("p")[0]["_at"].alias("first"), F.element_at("p", -1)["_at"].alias("last"))


#: Lines that continue the record before.
CONTINUES = r"^(?:\s+|\}|\)|\]|Caused by:|\.\.\. \d+ more|goroutine \d+ \[|created by |Traceback \(most recent call last\):$)"


def join_multiline(lines: DataFrame, keys: list[str], order: str, continues: str = CONTINUES, max_lines: int = 512, max_bytes: int = 1 << 20) -> DataFrame:
    """Lines that continue the one before joined to one record; longer than the caps, it goes on in another, marked truncated."""
    w = Window.partitionBy(*keys).orderBy(order)
    block = lines.withColumn("_block", F.sum((~F.col("line").rlike(continues)).cast("int")).over(w))
    own = Window.partitionBy(*keys, "_block").orderBy(order)
    cut = F.greatest(F.floor((F.row_number().over(own) - 1) / max_lines), F.floor((F.sum(F.octet_length("line") + 1).over(own) - 1) / max_bytes))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.col("line").alias("text"))))
    out = block.withColumn("_cut", cut).groupBy(*keys, "_block", "_cut").agg(parts.alias("p"))
    return out.select(*keys, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("body"), F.col("p")[0]["_at"].alias("first"), F.element_at("p", -1)["_at"].alias("last"), F.size("p").alias("n_lines"), (F.col("_cut") > 0).alias("truncated"))


# --- the whole chain

@dataclass(frozen=True)
class ChainConfig:
    scrub: list[Redaction] = field(default_factory=lambda: redactions(["defaults"]))
    lifts: list[Lift] = field(default_factory=list)
    enrich: bool = True
    overwrite: bool = False
    rules: list[Rule] = field(default_factory=list)
    routes: list[tuple[str, list[str]]] = field(default_factory=list)


def before_rules(logs: DataFrame, config: ChainConfig) -> DataFrame:
    """Scrubbed, lifted, enriched: what log metrics see."""
    return _before_rules(logs, config).drop(FIELDS)


def _before_rules(logs: DataFrame, config: ChainConfig) -> DataFrame:
    out = with_fields(logs.withColumn("body", scrub(F.col("body"), config.scrub)))
    out = lift_attributes(out, config.lifts) if config.lifts else out
    return enrich_lines(out, config.overwrite) if config.enrich else out


def run_log_chain(logs: DataFrame, config: ChainConfig, order: list[str], pods: DataFrame | None = None, source: list[str] = ()) -> DataFrame:
    """scrub, lift, enrich, (log metrics read the result,) workload rules, global rules, route. Sampling rules count in `order` for each source."""
    out = _before_rules(logs, config)
    out = workload_rules(out, pods) if pods is not None else out
    out = line_rules(out, config.rules, order, source) if config.rules else out
    return (route(out, config.routes) if config.routes else out).drop(FIELDS)


def check_config(spark, config: ChainConfig, cases: list[dict]) -> list[str]:
    """Runs sample lines through the chain at once; each case: line, and any of kept, body, severity, attributes. Returns what differs."""
    rows = [(k, c["line"], {}, {}, None, None) for k, c in enumerate(cases)]
    logs = spark.createDataFrame(rows, "log_id long, body string, attrs map<string,string>, resource map<string,string>, severity_text string, severity_number int")
    got = {r.log_id: r for r in run_log_chain(logs, config, ["log_id"]).collect()}  # the cases are a few lines of configuration
    wrong = []
    for k, c in enumerate(cases):
        row = got.get(k)
        if c.get("kept", True) != (row is not None):
            wrong.append(f"case {k}: kept is {row is not None}")
        if row is not None:
            wrong += [f"case {k}: {n} is {v!r}" for n, v in (("body", row.body), ("severity", row.severity_text)) if n in c and c[n] != v]
            wrong += [f"case {k}: attribute {n} is {row.attrs.get(n)!r}" for n, v in c.get("attributes", {}).items() if row.attrs.get(n) != v]
    return wrong
