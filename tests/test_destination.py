"""Destination projections: caps, rows that lack nearly all, tiers that never met, explanations."""

import json

import pytest
from pyspark.sql import functions as F

from lineup.operators import destination as D

SCHEMA = "id int, neutral double, neutral_low double, neutral_high double, usage double, source_usage double, returning_share double, source_tier int, target_tier int, minutes double, minutes_width double, games double, rates map<string,double>"


def _project(spark, rows, weight=1.0):
    train = spark.createDataFrame([(float(x), 2.0 * x - 30.0, 4, 1, -5.0) for x in range(10, 40)], "source_usage double, gain double, source_tier int, target_tier int, change double")
    role, tiers = D.fit_moves(train, "gain", ["source_usage"], "change")
    assert role["coef"][0] == pytest.approx(2.0) and role["intercept"] == pytest.approx(-30.0)
    out = D.project_destinations(spark.createDataFrame(rows, SCHEMA), role, tiers, {}, {}, weight)
    return {r["id"]: r for r in out.collect()}


def test_parts_are_capped_and_explained(spark):
    got = _project(spark, [(1, 2.0, 1.0, 4.0, 20.0, 20.0, 0.0, 4, 1, 20.0, 6.0, 30.0, {"pts_per_40": 20.0}), (2, 2.0, 1.0, 3.0, 20.0, 15.0, 100.0, 2, 2, 0.0, 6.0, 5.0, None)])
    a, b = got[1], got[2]
    # role 10 -> 0.75, roster 0.5, tier 0.8 * -0.75 + 0.2 * -5 -> -0.75: their sum is within the cap
    assert a["parts"] == pytest.approx([0.75, 0.0, 0.5, -0.75]) and a["value"] == pytest.approx(2.5)
    assert a["rates"] == pytest.approx({"pts_per_game": 10.0}) and json.loads(a["explanation"]) == {"source_tier": 4, "target_tier": 1, "largest": "role"}
    assert b["parts"] == pytest.approx([0.0, 0.0, -0.5, 0.0]) and b["value"] == pytest.approx(1.5) and b["rates"] == {}
    assert b["multiplier"] > 1.15 and a["low"] < a["value"] < a["high"] and a["multiplier"] == pytest.approx(1.0625 * 1.45)


def test_rows_that_lack_nearly_all(spark):
    got = _project(spark, [(1, None, None, None, None, None, None, None, None, None, None, None, None), (2, 1.0, None, None, 20.0, None, None, 1, 4, 10.0, 2.0, 20.0, {})])
    assert got[1]["value"] is None and got[1]["low"] is None and got[1]["parts"] == [0.0, 0.0, 0.0, 0.0]
    assert got[2]["parts"] == pytest.approx([0.0, 0.0, 0.0, 0.45]) and got[2]["value"] == pytest.approx(1.45) and got[2]["multiplier"] > 1.5


def test_the_sum_is_held_within_its_cap(spark):
    got = _project(spark, [(1, 0.0, -1.0, 1.0, 20.0, 30.0, 0.0, 1, 4, 20.0, 6.0, 30.0, {})])
    whole = 0.75 + 0.5 + 0.45
    assert got[1]["value"] == pytest.approx(1.5) and got[1]["parts"][0] == pytest.approx(0.75 * 1.5 / whole)


def test_schools_with_equal_minutes_tie(spark, tmp_path):
    """Copies of the players at schools of their own: minutes that differ only by the order of their additions are ties, as in the SQL."""
    import duckdb

    from lineup.plans import registry

    con = duckdb.connect()
    con.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + i * 1500 AS o_orderkey, o_custkey + i * 1200 AS o_custkey) FROM range(6) r(i), '/root/testdata/sf0.001/orders.parquet' o) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    got = {(r["player"], r["season"], r["source"], r["target"]): r for r in registry.QUERIES["C09b_destination_projection"](spark, str(tmp_path)).collect()}
    res = con.execute(registry.SQL["C09b_destination_projection"])
    names = [c[0] for c in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert len(want) == len(got) > 0
    for w in want:
        g = got[w["player"], w["season"], w["source"], w["target"]]
        assert (g["source_tier"], g["target_tier"]) == (w["source_tier"], w["target_tier"]) and g["tier"] == pytest.approx(w["tier"], abs=2e-6)
