"""Queries of typed attributes and nested bodies, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import typed
from ..operators.logs import Lift
from .log_queries import _STEPS, _scrubbed
from .views import log_table, view

SQL: dict[str, str] = {}


def log_typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed attributes of every JSON record, one a row; numbers in bodies of many forms."""
    rows = log_table(spark, sf_dir).filter("log_id % 4 = 0").withColumn("body", F.replace("body", F.lit('"user":'), F.concat(F.lit('"half":'), (F.col("log_id") / 8).cast("string"), F.lit(',"ok":true,"none":null,"user":'))))
    found = typed.typed_attributes(F.col("body"), [Lift(k, k) for k in ("user", "http.status", "http", "half", "ok", "none", "level", "took_ms")])
    return rows.select("log_id", F.explode(found)).select("log_id", "key", F.schema_of_variant("value").alias("kind"), typed.value_text(F.col("value")).alias("text"))


SQL["log_typed_attributes"] = """
WITH j AS (SELECT log_id, user_id, body FROM v_logs WHERE log_id % 4 = 0)
SELECT log_id, 'user' AS key, 'BIGINT' AS kind, user_id::VARCHAR AS text FROM j
UNION ALL SELECT log_id, 'http.status', 'BIGINT', body ->> '$.http.status' FROM j
UNION ALL SELECT log_id, 'half', CASE WHEN log_id % 8 = 0 THEN 'BIGINT' ELSE 'DOUBLE' END, CASE WHEN log_id % 8 = 0 THEN (log_id // 8)::VARCHAR ELSE (log_id // 8) || '.5' END FROM j
UNION ALL SELECT log_id, 'ok', 'BOOLEAN', 'true' FROM j
UNION ALL SELECT log_id, 'level', 'STRING', body ->> '$.level' FROM j
UNION ALL SELECT log_id, 'took_ms', 'BIGINT', body ->> '$.took_ms' FROM j
"""


def log_nested_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record inside a nested body: its text, a password, and the text again in a list."""
    line, secret = F.to_json(F.array("body")), F.md5(F.col("log_id").cast("string"))
    rows = log_table(spark, sf_dir, spread=True).withColumn("nested", F.concat(F.lit('{"n":1,"a":{"b":'), line, F.lit(',"password":"'), secret, F.lit('"},"note":"x","list":[['), line, F.lit("]]}")))
    out = rows.select("log_id", typed.scrub_json(F.col("nested"), _STEPS).alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return out.select("log_id", at("$.n").alias("n"), at("$.a.password").alias("password"), at("$.a.b[0]").alias("first"), at("$.list[0][0][0]").alias("second"), at("$.note").alias("note"))


SQL["log_nested_scrub"] = f"SELECT log_id, '1' AS n, '[REDACTED]' AS password, {_scrubbed(_STEPS)} AS first, {_scrubbed(_STEPS)} AS second, 'x' AS note FROM v_logs"


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and eighths as ECMAScript writes them."""
    rows = view(spark, sf_dir, "v_logs").select(F.col("log_id").alias("event_id"), "value").withColumn("x", F.floor(F.col("value") * 100) * 4.0 + 1)
    return rows.select("event_id", typed.number_text(F.col("x")).alias("whole"), typed.number_text(F.col("x") / 8).alias("eighths"))


SQL["number_texts"] = """
SELECT log_id AS event_id, (floor(value * 100) * 4 + 1)::BIGINT::VARCHAR AS whole, rtrim(((floor(value * 100) * 4 + 1)::BIGINT::DECIMAL(18, 3) / 8)::DECIMAL(18, 3)::VARCHAR, '0') AS eighths FROM v_logs
"""

QUERIES = {name: globals()[name] for name in SQL}
