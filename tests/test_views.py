"""Views that Spark reads by another statement than DuckDB."""

from __future__ import annotations

import duckdb

from obslake.plans import log_queries, source_queries, views

SF = "/root/testdata/sf0.001"


def test_samples_come_from_one_pass_over_the_events(spark):
    table = views.view(spark, SF, "v_samples")
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    con = duckdb.connect()
    con.sql(f"create view events as from '{SF}/events.parquet'")
    want = con.execute(views.samples(views.DUCK)).fetchall()
    assert len(want) > 0 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in table.collect())


def test_small_rows_of_much_work_are_dealt_first(spark):
    for query in (log_queries.log_derived_metrics, source_queries.otlp_points):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan
