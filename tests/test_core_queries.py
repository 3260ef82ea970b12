"""Registered queries on the small tables against their SQL."""

import pytest

from foresail import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, same, name):
    assert same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name]) > 0


@pytest.mark.parametrize("name", ["coverage_band", "fc_theta", "fc_ar", "mcs", "skill_bootstrap", "gate_decision", "transform_counts", "es_backtest", "fc_combination"])
def test_without_sql(spark, name):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert rows
    if "status" in rows[0]:
        # What is skipped is so exactly at origins without a value, for every model alike.
        blind = missing_origins(spark, name)
        assert {r.status for r in rows} <= {"ok", "skipped", "failed"}
        assert {(r.unique_id, r.origin_t) for r in rows if r.status == "skipped"} == blind
        assert all(((r.unique_id, r.origin_t) in blind) == (r.status == "skipped") for r in rows)
        assert not any(r.status == "failed" for r in rows if r.model != "sarima")


def missing_origins(spark, name):
    from foresail.operators import folds
    from foresail.plans import panels

    daily = name == "fc_ar"
    dense = panels.daily(spark, SMALL) if daily else panels.monthly(spark, SMALL)
    plan = folds.origins(dense, panels.DAILY if daily else panels.MONTHLY).select("unique_id", "origin_t")
    empty = dense.where("y IS NULL").select("unique_id", dense.pos.alias("origin_t"))
    return {(r.unique_id, r.origin_t) for r in plan.join(empty, ["unique_id", "origin_t"]).collect()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
