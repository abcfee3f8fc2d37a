"""A player's season before is found by sorting the player's seasons, not by joining all seasons with themselves."""

from lineup.operators import opportunity as Q


def test_player_context_joins_nothing(spark):
    rows = [(1, 2000, 5, 10.0, 20.0, 3.0), (1, 2001, 6, 30.0, 21.0, None), (1, 2003, 6, 40.0, 22.0, 5.0), (2, 2001, 5, None, 9.0, 6.0), (None, 2001, 5, 1.0, 1.0, 1.0), (None, 2002, 5, 1.0, 1.0, 1.0)]
    stats = spark.createDataFrame(rows, "player long, season int, school long, min_pct double, usage_rate double, games_played double")
    got = Q.player_context(stats, ["games_played"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    names = ["prior_college_seasons", "first_observed_season", "prior_school", "prior_min_pct", "prior_usage_rate", "prior_games_played"]
    found = {(r["player"], r["season"]): tuple(r[n] for n in names) for r in got.collect()}
    none = (None, None, None, None)
    assert found == {(1, 2000): (0, 2000, *none), (1, 2001): (1, 2000, 5, 10.0, 20.0, 3.0), (1, 2003): (2, 2000, *none), (2, 2001): (0, 2001, *none), (None, 2001): (None,) * 6, (None, 2002): (None,) * 6}
