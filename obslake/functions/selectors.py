"""Selectors over log records, and where a key's value is looked up.

A selector is a list of conditions, all of which must hold: key=value or key!=value, the value being exact in one list and a
regular expression, not anchored, in another. `__line__` is the body, `__severity__` the record's severity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE, SEVERITY = "__line__", "__severity__"
#: Severity bands of four numbers each.
BANDS = ("trace", "debug", "info", "warn", "error", "fatal")


def record_severity(text: Column, number: Column) -> Column:
    """Lower-cased severity text, else the band of the number, else the empty string."""
    band = F.lit("")
    for k, name in enumerate(BANDS):
        band = F.when(number.between(4 * k + 1, 4 * k + 4), name).otherwise(band)
    return F.when(F.coalesce(text, F.lit("")) != "", F.lower(text)).otherwise(band)


def is_json(body: Column) -> Column:
    return F.ltrim(body).startswith("{")


#: A key and its value in a logfmt line.
_PAIR = r'(?:^|\s)([^\s="]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def parsed_line(body: Column) -> Column:
    """A line understood once, for any number of field_of(): the members of a JSON body, else keys and values of a logfmt line, last first.

    What begins as JSON but isn't has no fields. Of a repeated key in JSON the first counts.
    """
    plain = F.when(~is_json(body), body)
    unquoted = lambda v: F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    part = lambda k: F.reverse(F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(k)))
    return F.struct(F.from_json(F.when(is_json(body), body), "map<string,string>").alias("json"), part(1).alias("keys"), F.transform(part(2), unquoted).alias("values"))


def _scalar(value: Column) -> Column:
    return F.when(~F.substring(value, 1, 1).isin("{", "["), value)


def field_of(fields: Column, key: str, dotted: bool = True) -> Column:
    """A field of a parsed_line(): JSON scalar at a dotted path (objects, arrays and null give null), or the last logfmt value; a bare key has none."""
    first, dot, rest = key.partition(".")
    member = F.get_json_object(fields["json"][first], "$." + rest) if dot and dotted else fields["json"][key]
    return F.coalesce(_scalar(member), F.try_element_at(fields["values"], F.nullif(F.array_position(fields["keys"], key), F.lit(0)).cast("int")))


def line_field(body: Column, key: str) -> Column:
    """A field of one line: JSON by path, else logfmt."""
    return field_of(parsed_line(body), key)


@dataclass(frozen=True)
class Record:
    """The columns that a key can be looked up in, from the closest to the line."""

    body: Column
    attrs: Column
    resource: Column
    severity_text: Column
    severity_number: Column
    lifted: Column | None = None
    #: parsed_line() of the body, where a column holds it already
    fields: Column | None = None

    @staticmethod
    def default(fields: str | None = None) -> Record:
        return Record(F.col("body"), F.col("attrs"), F.col("resource"), F.col("severity_text"), F.col("severity_number"), fields=F.col(fields) if fields else None)


def resolve(record: Record, key: str) -> Column:
    """Value of a key: record attribute (an empty one ends the search among attributes), lifted, resource; then the line's field."""
    if key == LINE:
        return record.body
    if key == SEVERITY:
        return record_severity(record.severity_text, record.severity_number)
    attribute = F.coalesce(record.attrs[key], *([record.lifted[key]] if record.lifted is not None else []), record.resource[key])
    return F.coalesce(F.nullif(attribute, F.lit("")), field_of(parsed_line(record.body) if record.fields is None else record.fields, key), F.lit(""))


def resolve_number(record: Record, key: str) -> Column:
    """Numeric value of a key, null where there is none; zero is a value."""
    return resolve(record, key).try_cast("double")


def parse_selector(text: str, regex: bool = False) -> tuple[str, bool, str]:
    """(key, wanted, value) of key=value or key!=value. An exact value may hold \\\\ and \\" as escapes; an empty key or a lone ! is refused."""
    m = re.match(r"^([^!=]+)(!?)=(.*)$", text, re.S)
    if not m:
        raise ValueError(f"not a selector: {text!r}")
    key, negated, value = m.groups()
    if regex:
        re.compile(value)
    else:
        value = re.sub(r'\\([\\"])', r"\1", value)
    return key, not negated, value


def match(record: Record, exact: list[str] = (), regex: list[str] = ()) -> Column:
    """Whether all conditions hold; no condition at all is refused."""
    if not exact and not regex:
        raise ValueError("an empty match is refused")
    out = F.lit(True)
    for key, wanted, value in (parse_selector(t) for t in exact):
        hit = resolve(record, key) == value
        out = out & (hit if wanted else ~hit)
    for key, wanted, value in (parse_selector(t, True) for t in regex):
        hit = resolve(record, key).rlike(value)
        out = out & (hit if wanted else ~hit)
    return out
