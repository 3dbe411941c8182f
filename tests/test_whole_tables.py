"""Queries over every order, part and customer, not over some of their ids."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
BY_KEY = {"plan_objective": ("plan_id", "lineitem", "l_orderkey"), "envelope_merge": ("l_orderkey", "lineitem", "l_orderkey"), "resolve_routes": ("route_id", "customer", "c_custkey"), "reference_paths": ("route_id", "customer", "c_custkey"), "waypoint_distances": ("route_id", "customer", "c_custkey")}


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", BY_KEY)
def test_every_key_has_rows(spark, name):
    from trackloom.plans.queries import QUERIES

    column, table, key = BY_KEY[name]
    found = {r[0] for r in QUERIES[name](spark, str(DATA)).select(column).distinct().collect()}
    assert found == {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().collect()}
