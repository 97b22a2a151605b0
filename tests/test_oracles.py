"""Every registered query of the library's own operators against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from obslake.plans.queries import oracle_sql, queries
from obslake.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def _rows(rows) -> list[str]:
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else int(x) if isinstance(x, bool) else x
    return sorted(str([float(p) if isinstance(p, int) else p for p in map(plain, r)]) for r in rows)


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys() and len(queries()) > 80


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches(spark, con, name):
    got = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(tuple(r) for r in got.select(*names).collect()) == _rows(want.fetchall())
