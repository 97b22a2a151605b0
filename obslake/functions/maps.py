"""Attribute maps: merging with precedence, filtering, canonical keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def merged(low: Column, high: Column) -> Column:
    """Both maps; where a key is in both, high's value."""
    return F.map_zip_with(F.coalesce(low, empty()), F.coalesce(high, empty()), lambda k, a, b: F.coalesce(b, a))


def identity_merged(sent: Column, resolved: Column, identity: Iterable[str]) -> Column:
    """resolved fills what sent lacks, and overwrites the identity keys."""
    keys = list(identity)
    return F.map_zip_with(F.coalesce(sent, empty()), F.coalesce(resolved, empty()), lambda k, s, r: F.when(k.isin(keys), F.coalesce(r, s)).otherwise(F.coalesce(s, r)))


def without(m: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(m, lambda k, v: ~k.isin(keys))


def non_empty(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def label_key(m: Column) -> Column:
    """Canonical text of a label set: sorted, escaped, empty values left out. Equal sets have equal keys."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r"\\\"")
    pairs = F.array_sort(F.map_entries(non_empty(m)))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ", "), F.lit("}"))


def label_set(key: Column) -> Column:
    """The map that label_key() gave a key for."""
    found = F.regexp_extract_all(key, F.lit(r'([^{},=" ][^="]*="(?:[^"\\]|\\.)*")'), F.lit(1))
    value = lambda t: F.regexp_replace(F.regexp_extract(t, r'="((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1")
    return F.map_from_entries(F.transform(found, lambda t: F.struct(F.regexp_extract(t, r'^([^=]+)=', 1).alias("key"), value(t).alias("value"))))
