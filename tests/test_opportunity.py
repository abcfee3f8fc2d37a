"""P61 and its contexts: look-ups by position, rosters in motion, features of sparse rows, and the stored fits of C08."""

import math

import pytest
from pyspark.sql import functions as F

from lineup.functions import opportunity as O
from lineup.operators import opportunity as Q


def test_by_position(spark):
    rows = [
        ("PG", {"PG": 3.0, "guard": 9.0}, 3.0),
        ("pg", {"pg": 4.0}, 4.0),
        ("SG", {"guard": 9.0, "total": 1.0}, 9.0),
        ("C", {"all": 7.0, "PG": 1.0}, 7.0),
        (None, {"PG": 2.0, "C": 4.0}, 3.0),
        ("PF", {"PF": None, "PG": 2.0}, 2.0),
        ("PF", {"PF": math.nan, "PG": 2.0}, 2.0),
        ("PF", {"PF": 900.0}, 200.0),
        ("PF", {"PF": -5.0}, 0.0),
        ("PF", {}, None),
        ("PF", None, None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, position string, m map<string,double>, want double")
    for r in df.withColumn("got", O.by_position(F.col("m"), F.col("position"))).collect():
        assert r["got"] == r["want"], r


def _stats(spark, rows):
    return spark.createDataFrame(rows, "player long, season int, school long, position string, min_pct double, usage_rate double, games_played double")


def _plain_flow(rows):
    """The flows by plain loops: (school, season) -> kind -> position -> sum of earlier minutes."""
    at = {(p, s): (school, pos, m, u) for p, s, school, pos, m, u, _ in rows}
    out = {}
    for (p, s), (school, pos, m, u) in at.items():
        old = at.get((p, s - 1))
        kind = "new" if old is None else "returning" if old[0] == school else "incoming"
        out.setdefault((school, s), []).append((kind, pos, old[2] * 0.4 if old else 0.0))
        new = at.get((p, s + 1))
        if new is None or new[0] != school:
            out.setdefault((school, s + 1), []).append(("departing", pos, m * 0.4))
    return out


def test_roster_flow_against_loops(spark):
    rows = [(p, s, (p * 7 + (s if p % 3 == 0 else 0)) % 5, ["PG", "SG", "SF", "PF", "C", None][p % 6], float((p * 13 + s * 5) % 90), float(10 + p % 15), 10.0) for p in range(60) for s in range(2000, 2004) if (p + s) % 4]
    got = {(r["school"], r["season"]): r for r in Q.roster_flow(_stats(spark, rows)).collect()}
    want = _plain_flow(rows)
    assert set(got) == set(want)
    for k, moves in want.items():
        for kind, column in (("returning", "returning_minutes_by_position"), ("departing", "departing_minutes_by_position"), ("incoming", "incoming_transfer_minutes_by_position")):
            sums = {}
            for what, pos, m in moves:
                if what == kind and pos:
                    sums[pos] = sums.get(pos, 0.0) + m
            assert got[k][column] == pytest.approx(sums), (k, kind)
        assert got[k]["roster_player_count"] == sum(what != "departing" for what, _, _ in moves)


def test_features_of_rows_that_lack_nearly_all(spark):
    df = spark.createDataFrame([(1, None, None), (2, "SG", math.nan)], "id int, position string, prior_min_pct double")
    f = O.opportunity_features(df.columns)
    a, b = df.select("id", *[c.alias(n) for n, c in f.items()]).orderBy("id").collect()
    for r in (a, b):
        assert (r["prior_minutes"], r["career_season_index"], r["is_no_prior_college_season"], r["position_confidence"], r["roster_reliability"], r["transfer_match_confidence"]) == (0.0, 1.0, 1.0, 0.5, 0.45, 1.0)
        assert r["projection_reliability"] == 0.5 and r["projection_ci_width"] is None and r["returning_minutes_position"] is None and r["position_opportunity_delta"] == 0.0
        assert r["missing_feature_count"] == sum(r[n] is None for n in f if n != "missing_feature_count")
    assert b["position_is_sg"] == b["position_group_guard"] == 1.0 and a["position_group_guard"] == 0.0


def test_frame_keeps_one_row_and_masks_leaks(spark):
    stats = _stats(spark, [(1, 2000, 1, "PG", 50.0, 20.0, 20.0), (1, 2001, 2, "PG", 80.0, 25.0, 30.0), (2, 2001, 2, None, 10.0, 8.0, 3.0)])
    facts = spark.createDataFrame([(1, 75.0), (1, 76.0)], "player long, height_inches double")
    projections = spark.createDataFrame([(1, 2001, "own", 3.0, 1.0, 5.0), (2, 2001, "forecast", 2.0, 1.0, 5.0)], "player long, season int, version string, value_per_100 double, value_ci_lower double, value_ci_upper double")
    transfers = spark.createDataFrame([(1, 2001, 2, 0.7), (1, 2001, 2, 0.9)], "player long, season int, school long, match_confidence double")
    ratings = spark.createDataFrame([(2, 2001, 1.5)], "school long, season int, team_adj_em double")
    rows = Q.opportunity_frame(stats, ["games_played"], facts, projections, transfers, ratings, "forecast").collect()
    got = {(r["player"], r["season"]): r for r in rows}
    assert len(rows) == 3
    mover = got[1, 2001]
    assert (mover["value_per_100"], mover["is_transfer"], mover["transfer_match_confidence"], mover["prior_minutes"], mover["prior_games_played"], mover["height_inches"]) == (None, 1.0, 0.9, 20.0, 20.0, 75.0)
    assert mover["sample_reliability"] == pytest.approx(math.sqrt(50 / 55)) and mover["incoming_transfer_minutes_position"] == 20.0
    other = got[2, 2001]
    assert (other["value_per_100"], other["projection_ci_width"], other["team_adj_em"], other["same_position_prior_count"]) == (2.0, 4.0, 1.5, None)
    assert Q.opportunity_frame(stats.limit(0), ["games_played"], facts, projections, transfers, ratings, "forecast").collect() == []


def test_playing_time_updates_stored_fits(spark):
    from lineup.plans import registry

    rows = registry.QUERIES["C08_playing_time"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r["player"], r["season"]) for r in rows}) == len(rows)
    for r in rows:
        assert r["gap_match"] == (40 + r["player"] % 21 if r["player"] % 2 == 0 else 50.0)
        assert 0 <= r["role_fit"] <= 100 and 0 <= r["low"] <= r["high"] <= 1 and r["role"] is not None
