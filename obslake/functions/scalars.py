"""Scalar functions over columns: identities, durations, numbers, text cuts. No Python runs on the data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds in seconds of the duration histograms.
SPAN_BOUNDS = (0.002, 0.004, 0.006, 0.008, 0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.0, 1.4, 2.0, 5.0, 10.0, 15.0)
EDGE_BOUNDS = tuple(0.1 * 2**k for k in range(8))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_utf8(text: Column | str, n: int = 256) -> Column:
    """The longest prefix of whole characters within n bytes."""
    text = _col(text)
    raw = F.encode(text, "UTF-8")
    inner = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")  # noqa: E731  a byte inside a character
    size = F.lit(max(0, n - 3))
    for k in (2, 1, 0):
        size = F.when(~inner(n - k + 1), F.lit(max(0, n - k))).otherwise(size)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(raw.substr(F.lit(1), size), "UTF-8"))


def normalize_container_id(value: Column | str) -> Column:
    """What follows the last colon of a trimmed id, without slashes and spaces."""
    return F.regexp_replace(F.regexp_replace(F.btrim(_col(value)), r"^.*:", ""), r"[/ ]", "")


def service_name(owners: Column | str, pod: Column | str) -> Column:
    """Name of the last workload among owners (array of structs kind, name), else the pod's."""
    workloads = F.filter(_col(owners), lambda o: o["kind"].isin("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob"))
    return F.coalesce(F.try_element_at(workloads, F.lit(-1))["name"], _col(pod))


def cgroup_identity(path: Column | str) -> Column:
    """Struct pod_uid, container_id, is_pod_container of a cgroup path of either driver layout."""
    path = _col(path)
    uid = F.regexp_extract(path, r"pod([0-9a-f]{8}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{12}|[0-9a-f]{32})(?:\.slice)?(?:/|$)", 1)
    container = F.regexp_extract(path, r"(?:^|/)(?:[a-z]+-)*([0-9a-f]{64})(?:\.scope)?(?:/|$)", 1)
    return F.struct(
        F.nullif(F.replace(uid, F.lit("_"), F.lit("-")), F.lit("")).alias("pod_uid"),
        F.nullif(container, F.lit("")).alias("container_id"),
        ((uid != "") & (container != "")).alias("is_pod_container"),
    )


def arm_id(path: Column | str) -> Column:
    """Struct subscription, group, type, name of a cloud resource id, lower-cased; a nested provider starts the type anew."""
    low = F.lower(_col(path))
    last = F.regexp_extract(low, r".*/providers/(.+?)/*$", 1)
    parts = F.split(last, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    types = F.filter(steps, lambda k: k % 2 == 1)
    kind = F.array_join(F.concat(F.array(parts[0]), F.transform(types, lambda k: F.get(parts, k))), "/")
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        some(F.regexp_extract(low, r"/subscriptions/([^/]+)", 1)).alias("subscription"),
        some(F.regexp_extract(low, r"/resourcegroups/([^/]+)", 1)).alias("group"),
        F.when(last != "", kind).alias("type"),
        F.when((last != "") & (F.size(parts) > 2), F.element_at(parts, -1)).alias("name"),
    )


def hex_id(value: Column | str, length: int) -> Column:
    """A hexadecimal id of exactly this length after dashes go, lower-cased; all zeros or anything else: null."""
    x = F.lower(F.replace(_col(value), F.lit("-"), F.lit("")))
    return F.when(x.rlike(rf"^[0-9a-f]{{{length}}}$") & ~x.rlike("^0+$"), x)


def render_number(token: Column | str) -> Column:
    """A JSON number as text: integers as they stand, other numbers in shortest form, whole ones without a fraction."""
    token = _col(token)
    number = token.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(token.rlike(r"^-?\d+$"), token).when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def span_nanos(start: Column | str, end: Column | str) -> Column:
    """Duration in nanoseconds; zero where the end is no later than the start."""
    return F.greatest(_col(end) - _col(start), F.lit(0).cast("long"))


def bucket_index(value: Column, bounds: tuple[float, ...]) -> Column:
    """Index of the first bound that is at least the value, else the number of bounds."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))


def span_size(name: Column | str, attrs: Column | str) -> Column:
    """Bytes of a span's name, ids and string attributes."""
    entries = F.map_entries(F.coalesce(_col(attrs), F.create_map().cast("map<string,string>")))
    return F.octet_length(_col(name)) + 24 + F.aggregate(entries, F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))


#: Milliseconds of the units of a duration.
_UNITS = {"y": 31_536_000_000, "w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000, "ms": 1}


def prom_duration_ms(value: Column | str) -> Column:
    """Milliseconds of a duration such as 1d12h, its units in falling order; 0 may go without unit; anything else null."""
    value = _col(value)
    shape = "^" + "".join(rf"(?:(\d+){u})?" for u in _UNITS) + "$"
    total = F.lit(0).cast("long")
    for k, unit in enumerate(_UNITS.values(), 1):
        total = total + F.coalesce(F.nullif(F.regexp_extract(value, shape, k), F.lit("")).try_cast("long"), F.lit(0)) * unit
    return F.when(value == "0", F.lit(0).cast("long")).when((value != "") & value.rlike(shape), total)


def parse_duration_ms(text: str) -> int:
    """prom_duration_ms() for configuration values; fails on anything else."""
    m = re.fullmatch("".join(rf"(?:(\d+){u})?" for u in _UNITS), text) if text else None
    if not m and text != "0":
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n or 0) * ms for n, ms in zip(m.groups(), _UNITS.values())) if m else 0


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def glob_match(pattern: str, value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit("")).rlike(glob_regex(pattern))


def instance_id(container_id: Column, uid: Column, container: Column, namespace: Column, pod: Column, node: Column) -> Column:
    """The most exact identity that is known: container id, uid/container, uid, ns/pod/container, ns/pod, node."""
    known = lambda *cs: F.when(_all([F.coalesce(c, F.lit("")) != "" for c in cs]), F.concat_ws("/", *cs))
    return F.coalesce(known(container_id), known(uid, container), known(uid), known(namespace, pod, container), known(namespace, pod), known(node))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def target_url(scheme: Column, ip: Column, port: Column, path: Column) -> Column:
    """URL of an endpoint; IPv6 addresses stand in brackets."""
    host = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    return F.concat(scheme, F.lit("://"), host, F.lit(":"), port.cast("string"), path)


def target_instance(url: Column | str) -> Column:
    """host:port of a URL."""
    return F.regexp_extract(_col(url), r"^[a-z]+://(\[[^\]]+\]:\d+|[^/]+)", 1)


def file_identity(path: Column | str) -> Column:
    """Struct pod, namespace, container, container_id of a <pod>_<namespace>_<container>-<id>.log path; other paths: null."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    shape = r"^([^_]+)_([^_]+)_(.+)-([0-9a-f]{64})\.log$"
    return F.when(name.rlike(shape), F.struct(*(F.regexp_extract(name, shape, k).alias(n) for k, n in enumerate(("pod", "namespace", "container", "container_id"), 1))))


def path_attributes(path: Column | str, patterns: list[str]) -> Column:
    """Map of the named groups of the patterns in a path; empty groups are left out, later patterns win."""
    last: dict[str, Column] = {}
    for p in patterns:
        plain = re.sub(r"\(\?P<[A-Za-z_]\w*>", "(", p)
        for name, k in re.compile(p).groupindex.items():
            found = F.nullif(F.regexp_extract(_col(path), plain, k), F.lit(""))
            last[name] = F.coalesce(found, last[name]) if name in last else found
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in last.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
