"""Rows on which a query and its SQL would differ if they stated different rules."""

import duckdb
import pytest

from numeriq.plans.registry import ORACLES, QUERIES


def both(spark, folder, name):
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from read_parquet('{folder}/lineitem.parquet')")
    want = duck.sql(ORACLES[name])
    return sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select(*want.columns).collect()), sorted(want.fetchall())


def test_gains_that_differ_below_eight_digits(spark, tmp_path):
    rows = "SELECT v / 100.0::DOUBLE AS l_discount, y AS l_returnflag FROM range(3) a(v), (VALUES ('A'), ('N')) b(y), range(6000) c(n)"
    duckdb.sql(f"COPY ({rows} UNION ALL SELECT 0.02, 'A' UNION ALL SELECT 0.02, 'A') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = both(spark, tmp_path, "gini_best_split")
    assert got == want and got[0][1] == pytest.approx(0.015) and 0 <= got[0][2] < 1e-8

