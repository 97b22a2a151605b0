"""Resource attributes of a record's context, and what comes and goes with whole resources."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.scalars import instance_id

#: Attributes that a context gives by default, and the column that holds each.
DEFAULTS = {
    "k8s.node.name": "node",
    "k8s.namespace.name": "namespace",
    "k8s.pod.name": "pod",
    "k8s.pod.uid": "pod_uid",
    "k8s.container.name": "container",
    "container.id": "container_id",
    "service.name": "service",
}
NAMESPACE, INSTANCE = "service.namespace", "service.instance.id"


@dataclass(frozen=True)
class ResourceConfig:
    """static: fixed attributes; templates: SQL expressions over the row; enable, disable: patterns of whole attribute names."""

    defaults: bool = True
    static: dict[str, str] = field(default_factory=dict)
    templates: dict[str, str] = field(default_factory=dict)
    instance_prefix: str = ""
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for p in (*self.enable, *self.disable):
            re.compile(p)


def build_resource(rows: DataFrame, config: ResourceConfig = ResourceConfig(), context: dict[str, str] | None = None) -> DataFrame:
    """rows with resource: what it had, then the context's defaults, static attributes and templates, each over the one before.

    context: attribute to column (DEFAULTS, as far as rows has the columns). What is null or empty sets nothing. The service's namespace and
    instance are then filled in if absent, from the namespace and the most exact identity known; the prefix goes before the instance; last, the
    filter keeps the names that match an enabling pattern (or all) and no disabling one.
    """
    context = {a: c for a, c in (context or DEFAULTS).items() if c in rows.columns}
    pairs = lambda named: maps.non_empty(F.create_map(*(x for k, c in named.items() for x in (F.lit(k), c.cast("string"))))) if named else maps.empty()
    layers = [F.col("resource")] if "resource" in rows.columns else []
    layers += [pairs({a: F.col(c) for a, c in context.items()})] if config.defaults else []
    layers += [pairs({k: F.lit(v) for k, v in config.static.items()}), pairs({k: F.expr(e) for k, e in config.templates.items()})]
    out = rows.withColumn("resource", layers[0])
    for layer in layers[1:]:
        out = out.withColumn("resource", maps.merged(F.col("resource"), layer))
    at = lambda k: F.col("resource")[k]
    own = instance_id(at("container.id"), at("k8s.pod.uid"), at("k8s.container.name"), at("k8s.namespace.name"), at("k8s.pod.name"), at("k8s.node.name"))
    out = out.withColumn("resource", maps.merged(pairs({NAMESPACE: at("k8s.namespace.name"), INSTANCE: own}), F.col("resource")))
    if config.instance_prefix:
        out = out.withColumn("resource", F.transform_values("resource", lambda k, v: F.when(k == INSTANCE, F.concat(F.lit(config.instance_prefix), v)).otherwise(v)))
    keep = lambda k: _matches(k, config.enable, True) & ~_matches(k, config.disable, False)
    return out.withColumn("resource", F.map_filter("resource", lambda k, v: keep(k))) if config.enable or config.disable else out


def _matches(key: Column, patterns: tuple[str, ...], none: bool) -> Column:
    some = [p.strip() for p in patterns if p.strip()]
    return key.rlike("^(?:" + "|".join(f"(?:{p})" for p in some) + ")$") if some else F.lit(none)


def drop_empty_metrics(pushed: DataFrame) -> DataFrame:
    """pushed (…, metrics array<struct<…, points array>>) without metrics that have no points, with dropped: how many went; rows left without metrics go.

    A row is a scope of a resource, so a resource whose scopes are all gone is gone too. Count what goes with empty_metrics().
    """
    kept = F.filter("metrics", lambda m: F.coalesce(F.size(m["points"]), F.lit(0)) > 0)
    out = pushed.withColumns({"dropped": F.size("metrics") - F.size(kept), "metrics": kept})
    return out.filter(F.size("metrics") > 0)


def empty_metrics(pushed: DataFrame) -> Column:
    """An aggregate over pushed: metrics without points."""
    return F.sum(F.size(F.filter("metrics", lambda m: F.coalesce(F.size(m["points"]), F.lit(0)) == 0)))


def hooked_targets(targets: DataFrame, keep: Column | None = None, path: Column | None = None) -> DataFrame:
    """targets that a hook doesn't drop (keep is false), with the path that it gives and the URL made anew; no answer changes nothing."""
    out = targets if keep is None else targets.filter(F.coalesce(keep, F.lit(True)))
    if path is None:
        return out
    base, old = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    new = F.coalesce(F.nullif(path, F.lit("")), old)
    return out.withColumn("url", F.concat(base, F.when(new.startswith("/"), new).otherwise(F.concat(F.lit("/"), new))))
