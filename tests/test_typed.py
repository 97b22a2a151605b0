"""Typed attributes, their text, and redaction inside nested bodies."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from obslake.operators import logs, typed
from obslake.operators.logs import Lift

LINE = '{"id": 9007199254740993, "big": 18446744073709551616, "half": 0.5, "whole": 2.0, "exp": 1e3, "ok": true, "name": "x", "none": null, "list": [1], "a": {"b": {"c": -7}}, "quoted": "12"}'


def test_values_keep_their_types(spark):
    rules = [Lift(k, k) for k in ("id", "big", "half", "whole", "exp", "ok", "name", "none", "list", "a", "a.b.c", "quoted", "gone")] + [Lift("id", "r", "resource")]
    row = spark.createDataFrame([(LINE,)], "body string").select(typed.typed_attributes(F.col("body"), rules).alias("m"))
    got = {r.key: (r.kind, r.text) for r in row.select(F.explode("m")).select("key", F.schema_of_variant("value").alias("kind"), typed.value_text(F.col("value")).alias("text")).collect()}
    assert got == {
        "id": ("BIGINT", "9007199254740993"), "big": ("DOUBLE", "18446744073709552000"), "half": ("DOUBLE", "0.5"), "whole": ("BIGINT", "2"), "exp": ("BIGINT", "1000"),
        "ok": ("BOOLEAN", "true"), "name": ("STRING", "x"), "a.b.c": ("BIGINT", "-7"), "quoted": ("STRING", "12"),
    }


def test_other_lines(spark):
    rules = [Lift("n", "n"), Lift("ok", "ok")]
    rows = spark.createDataFrame([("n=1 n=2 ok",), ('{"n":1,"n":2}',), ("plain",), ("",), (None,), ('{"n":',)], "body string").select(typed.typed_attributes(F.col("body"), rules).alias("m"))
    got = [{k: v.toPython() for k, v in m.m.items()} for m in rows.collect()]
    assert got == [{"n": "2"}, {"n": "1"}, {}, {}, {}, {}]
    assert spark.range(1).select(typed.typed_attributes(F.lit("n=1"), [], "log").alias("m")).first().m == {}


@pytest.mark.parametrize(("x", "want"), [(1.0, "1"), (0.1, "0.1"), (-123.456, "-123.456"), (1e7, "10000000"), (123456789.5, "123456789.5"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"),
    (1e-6, "0.000001"), (1.25e-5, "0.0000125"), (5e-7, "5e-7"), (-1.5e-9, "-1.5e-9"), (0.0, "0"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (100.0, "100"), (None, None)])
def test_numbers_read_as_ecmascript_writes_them(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(typed.number_text(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("body", "want"), [
    ({"user": "u", "password": "hunter2", "n": 1.50, "deep": [{"x": {"api_key": "k k"}}, "Bearer abc.def"]}, {"user": "u", "password": "[REDACTED]", "n": 1.5, "deep": [{"x": {"api_key": "[REDACTED] k"}}, "Bearer [REDACTED]"]}),
    ({"token": ["one", ["two"], {"other": "three"}], "after": "four"}, {"token": ["[REDACTED]", ["[REDACTED]"], {"other": "three"}], "after": "four"}),
    (["password=x \"q\"", "fine", None, True], ["password=[REDACTED] \"q\"", "fine", None, True]),
    ({"secret": "", "note": "a\nbé \\ /"}, {"secret": "", "note": "a\nbé \\ /"}),
    ({}, {}),
])
def test_leaves_are_scrubbed_wherever_they_are(spark, body, want):
    steps = logs.redactions(["defaults"])
    got = spark.createDataFrame([(json.dumps(body),)], "b string").select(typed.scrub_json(F.col("b"), steps)).first()[0]
    assert json.loads(got) == want


def test_lines_and_depth(spark):
    steps = logs.redactions(["defaults"])
    deep = '{"a":' * 8 + '{"password":"x"}' + "}" * 8
    shallow = '{"a":' * 7 + '{"password":"x"}' + "}" * 7
    rows = [("password=x",), ('{"password":"x"',), (deep,), (shallow,), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string").select(typed.scrub_json(F.col("b"), steps)).collect()]
    assert got == ["password=[REDACTED]", '{"password":"[REDACTED]"', deep, shallow.replace('"x"', '"[REDACTED]"'), None, ""]


def _text(spark, column):
    return spark.createDataFrame([("x",)], "b string").select(column.alias("c"))._jdf.queryExecution().analyzed().toString()


def test_values_are_scrubbed_once_alone_and_once_by_name(spark):
    steps = logs.redactions(["defaults"])
    count = lambda c: _text(spark, c).count("regexp_replace(")
    assert count(logs.scrub_structured(F.create_map(F.lit("k"), F.col("b")), steps)) == 2 * count(logs.scrub(F.col("b"), steps))
    body = F.create_map(F.lit("password"), F.lit("x y"), F.lit("token"), F.lit(None), F.lit("note"), F.lit("pwd='a b' \"q\""), F.lit("s"), F.lit('secret: "a b"'))
    got = spark.range(1).select(logs.scrub_structured(body, steps).alias("m")).first().m
    assert got == {"password": "[REDACTED] y", "token": None, "note": "pwd='[REDACTED]' \"q\"", "s": 'secret: "[REDACTED]"'}


def test_bodies_are_walked_without_an_array_of_tokens(spark):
    """It would be copied at each token, so that a body of twice the length took four times as long."""
    steps = logs.redactions(["defaults"])
    assert _text(spark, typed.scrub_json(F.col("b"), steps)).count("array_append(") == 1
    blanks = '{ "pass\\u0077ord" : "x" , "a" :[ 1 ,\t"Bearer abc" , {"b": null} , true ],"token" : [ "y" ] , "end:" : "z\\n:" }'
    long = [{"password": f"p{k}", "n": k} for k in range(2000)]
    frame = spark.createDataFrame([(blanks,), (json.dumps(long),)], "b string").coalesce(1)
    got = [r[0] for r in frame.select(typed.scrub_json(F.col("b"), steps)).collect()]
    assert got[0] == '{"pass\\u0077ord":"[REDACTED]","a":[1,"Bearer [REDACTED]",{"b":null},true],"token":["[REDACTED]"],"end:":"z\\n:"}'
    assert json.loads(got[1]) == [{"password": "[REDACTED]", "n": k} for k in range(2000)]
