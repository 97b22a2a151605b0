"""Attributes that keep the type of what a line says, and redaction of bodies of any shape.

Values are VARIANTs: whole numbers exact as longs, other numbers as doubles (whole ones as longs), booleans and strings. Their text is that of ECMAScript, so one field
reads the same whether it is an attribute or a label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.selectors import field_of, is_json, parsed_line
from .logs import Lift, Redaction, scrub, scrub_named


def _path(key: str) -> str:
    return "$" + "".join('["' + part.replace('"', '\\"') + '"]' for part in key.split("."))


def typed_value(found: Column) -> Column:
    """A VARIANT's scalar with its type; objects, arrays and null give null."""

    def typed(x: Column) -> Column:
        kind, number = F.schema_of_variant(x), F.try_variant_get(x, "$", "double")
        whole = (number == F.floor(number)) & (F.abs(number) < 2.0**63)
        real = F.when(whole, number.cast("long").cast("variant")).otherwise(number.cast("variant"))
        return F.when(kind.isin("BIGINT", "STRING", "BOOLEAN"), x).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), real)

    return F.transform(F.array(found), typed)[0]


def typed_attributes(body: Column, rules: list[Lift], target: str = "log") -> Column:
    """Map of VARIANTs that the rules for a target find in a line; what isn't there, null, objects and arrays are left out.

    A JSON body is parsed once; in one that repeats a key, or in a logfmt line, values are strings.
    """
    own = [r for r in rules if r.target == target]
    if not own:
        return F.create_map().cast("map<string,variant>")

    def found(parsed: Column) -> Column:
        pairs = []
        for r in own:
            text = field_of(parsed["fields"], r.field).cast("variant")
            pairs += [F.lit(r.attribute), F.when(parsed["json"].isNotNull(), typed_value(F.try_variant_get(parsed["json"], _path(r.field), "variant"))).otherwise(text)]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    once = F.struct(F.when(is_json(body), F.try_parse_json(body)).alias("json"), parsed_line(body).alias("fields"))
    return F.transform(F.array(once), found)[0]


def number_text(value: Column) -> Column:
    """A double as ECMAScript writes it: plain digits from 1e-6 below 1e21, else an exponent without padding."""

    def write(parts: Column) -> Column:
        sign, digits, e = parts["sign"], parts["digits"], parts["e"]
        size = F.length(digits)
        plain = (
            F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
            .when(size <= e + 1, F.rpad(digits, e + 1, F.lit("0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, size)))
        )
        short = F.when(size == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), size)))
        power = F.concat(short, F.when(e < 0, "e-").otherwise("e+"), F.abs(e).cast("string"))
        return F.concat(sign, F.when((e >= -6) & (e < 21), plain).otherwise(power))

    text = value.cast("string")  # shortest digits, as 123.4 or as 1.234E7
    whole, rest, power = (F.regexp_extract(text, r"^-?(\d+)(?:\.(\d+))?(?:E(-?\d+))?$", k) for k in (1, 2, 3))
    shown = F.concat(whole, rest)
    leading = F.length(shown) - F.length(F.ltrim(shown, F.lit("0")))
    digits = F.rtrim(F.ltrim(shown, F.lit("0")), F.lit("0"))
    e = F.coalesce(F.nullif(power, F.lit("")).cast("int"), F.lit(0)) + F.length(whole) - 1 - leading
    parts = F.struct(F.when(value < 0, "-").otherwise("").alias("sign"), digits.alias("digits"), e.alias("e"))
    special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").when(value == 0, F.when(text.startswith("-"), "-0").otherwise("0"))
    return F.coalesce(special, F.transform(F.array(parts), write)[0])


def value_text(value: Column) -> Column:
    """The text of a typed_value()."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "DOUBLE", number_text(F.try_variant_get(value, "$", "double"))).otherwise(F.try_variant_get(value, "$", "string"))


#: Tokens of JSON (names with their colon, strings, brackets, what is between them), white space, and levels of nesting below which nothing is looked at.
_TOKEN, _BLANKS, DEPTH = r'("(?:[^"\\]|\\.)*"(?:\s*:)?|[{}\[\]]|[^{}\[\]"]+)', " \t\n\r", 8


def scrub_json(body: Column, steps: list[Redaction]) -> Column:
    """A body with its secrets redacted: as a line, or, where it is a JSON object or array, in every string value down to DEPTH levels.

    A value is tried alone, and as key=value if that finds nothing; elements of an array have the key of what holds it. Values that hold no secret
    stay as they were written, and white space between tokens goes.
    """
    quoted = lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
    unescaped = lambda t: F.when(t.contains("\\"), quoted(t)).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))

    def leaf(key: Column, token: Column) -> Column:
        def tried(v: Column) -> Column:
            def written(new: Column) -> Column:
                text = F.to_json(F.array(new))
                return F.when(new.isNull() | (new == v), token).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))

            def judged(alone: Column) -> Column:
                return F.when((alone != v) | (key == ""), alone).otherwise(scrub_named(key, v, steps))

            return F.transform(F.transform(F.array(scrub(v, steps)), judged), written)[0]

        return F.transform(F.array(unescaped(token)), tried)[0]

    def step(acc: Column, t: Column) -> Column:
        stack, key, out = acc["stack"], acc["key"], acc["out"]
        then = lambda stack, key, text: F.struct(stack.alias("stack"), key.alias("key"), F.concat(out, text).alias("out"))
        name = F.rtrim(F.left(t, F.length(t) - 1), F.lit(_BLANKS))
        return (
            F.when(t.startswith('"'), F.when(t.endswith(":"), then(stack, unescaped(name), F.concat(name, F.lit(":")))).otherwise(then(stack, key, F.when(F.size(stack) <= DEPTH, leaf(key, t)).otherwise(t))))
            .when(t.isin("{", "["), then(F.array_append(stack, key), key, t))
            .when(t.isin("}", "]"), then(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))), F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")), t))
            .otherwise(then(stack, key, F.translate(t, _BLANKS, "")))
        )

    # what is written so far is a text: an array of tokens would be copied, token by token, at each of them
    tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(1))
    walked = F.aggregate(tokens, F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("key"), F.lit("").alias("out")), step)["out"]
    return F.when(F.ltrim(body).rlike(r"^[{\[]") & F.try_parse_json(body).isNotNull(), walked).otherwise(scrub(body, steps))
