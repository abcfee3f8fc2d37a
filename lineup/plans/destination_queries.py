"""Destination projections: the moves of ``success_queries``, of which the later ones are projected by models of the earlier ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import destination as D
from lineup.operators import joins as J
from lineup.operators import opportunity as Q
from lineup.operators import windows as W
from lineup.plans.base import Registry, r6, table
from lineup.plans.opportunity_queries import _STATS, _stats
from lineup.sources import io

R = Registry()

_FIRST = 2000  # moves before this season are learned from, the others are projected
_RANKS = ["1-URGENT", "2-HIGH"]


def _pairs(spark, d):
    """Moves with tiers of both schools by their earlier minutes, the neutral value of the best version, and the rates of the season before."""
    s = io.stage(_stats(spark, d), "seasons")
    team = Q.team_context(s).select("school", "season", r6("prior_team_minutes"), "prior_team_usage_total")  # schools with equal minutes tie, in whatever order they were added
    tiers = io.stage(W.competition_tier(team, "season", "prior_team_minutes", "tier", "min"), "tiers")
    versions = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    neutral = W.priority_resolve(versions, "o_custkey", "o_orderpriority", _RANKS, F.desc("o_orderdate"), F.desc("o_orderkey"))
    neutral = neutral.select(F.col("o_custkey").alias("player"), (F.col("o_totalprice") / 100003 - 2).alias("neutral"))
    before = s.select("player", "season", F.col("school").alias("source"), F.col("usage_rate").alias("source_usage"), F.col("min_pct").alias("was"), "games_played", F.create_map(F.lit("pts_per_40"), F.col("points_per_game")).alias("rates"))
    now = s.select("player", "season", F.col("school").alias("target"), F.col("usage_rate").alias("usage"), (F.col("min_pct") / 100 * 40).alias("minutes"))
    m = J.season_offset_join(before, now, ["player"], "season", 1).where("source <> target").withColumn("season", F.col("season") + 1)
    side = lambda at, more=(): tiers.select(F.col("school").alias(at), "season", F.col("tier").alias(f"{at}_tier"), *more)
    m = m.join(side("source"), ["source", "season"], "left").join(side("target", ["prior_team_minutes"]), ["target", "season"], "left")
    m = J.inner_gate(m, neutral, ["player"])
    return m.withColumns({
        "source_tier": F.coalesce("source_tier", F.lit(4)),
        "target_tier": F.coalesce("target_tier", F.lit(4)),
        "gain": F.col("usage") - F.col("source_usage"),
        "neutral_low": F.when(F.col("player") % 8 > 0, F.col("neutral") - 1 - F.col("player") % 3),
        "neutral_high": F.when(F.col("player") % 8 > 0, F.col("neutral") + 1 + F.col("player") % 3),
        "returning_share": F.least(F.col("prior_team_minutes") / 2.03, F.lit(100.0)),
        "minutes_width": F.lit(6.0),
        "games": F.col("games_played") * 6,
    })


@R("C09b_destination_projection", f"""WITH s AS {_STATS}, tc AS (SELECT school, season + 1 AS season, round(sum(min_pct / 100 * 40), 6) AS tm FROM s GROUP BY school, s.season),
t AS (SELECT *, CASE WHEN p >= 0.75 THEN 1 WHEN p >= 0.45 THEN 2 WHEN p >= 0.2 THEN 3 ELSE 4 END AS tier FROM (SELECT *, percent_rank() OVER (PARTITION BY season ORDER BY tm) AS p FROM tc)),
nv AS (SELECT o_custkey, o_totalprice / 100003 - 2 AS neutral FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1),
m AS (SELECT n.player, n.season, b.school AS source, n.school AS target, coalesce(x.tier, 4) AS st, coalesce(y.tier, 4) AS dt, least(y.tm / 2.03, 100) AS back, y.tm IS NULL AS newcomer, b.usage_rate AS su, n.usage_rate AS u, n.usage_rate - b.usage_rate AS gain, n.min_pct / 100 * 40 AS minutes, b.points_per_game AS pts, b.games_played * 6 AS games, neutral
  FROM s b JOIN s n ON n.player = b.player AND n.season = b.season + 1 AND n.school <> b.school JOIN nv ON o_custkey = n.player LEFT JOIN t x ON x.school = b.school AND x.season = n.season LEFT JOIN t y ON y.school = n.school AND y.season = n.season),
f AS (SELECT regr_slope(gain, su) AS a, regr_intercept(gain, su) AS b, sqrt(regr_syy(gain, su) * (1 - regr_r2(gain, su)) / count(*)) AS sd FROM m WHERE season < {_FIRST}),
c AS (SELECT st, dt, count(*) AS n, avg(gain / 7) AS mean FROM m WHERE season < {_FIRST} GROUP BY 1, 2),
k AS (SELECT m.*, f.sd, CASE WHEN m.dt < m.st THEN -0.25 * (m.st - m.dt) ELSE 0.15 * (m.dt - m.st) END AS prior, n, mean, f.a * su + f.b AS guess,
  CASE WHEN newcomer THEN 0 WHEN back <= 25 THEN 0.5 - back / 25 * 0.3 WHEN back <= 50 THEN 0.2 - (back - 25) / 25 * 0.2 WHEN back <= 75 THEN -(back - 50) / 25 * 0.25 ELSE -0.25 - (back - 75) / 25 * 0.25 END AS roster FROM m JOIN f ON true LEFT JOIN c ON c.st = m.st AND c.dt = m.dt WHERE season >= {_FIRST}),
e AS (SELECT *, least(greatest(guess * 0.05, -0.75), 0.75) AS d1, (player % 100 - 50) / 50.0 * 0.35 * 0.12 AS d2, least(greatest(roster, -0.5), 0.5) AS d3, least(greatest(CASE WHEN coalesce(n, 0) >= 20 THEN 0.8 * prior + 0.2 * mean ELSE prior END, -0.75), 0.75) AS d4 FROM k),
g AS (SELECT *, d1 + d2 + d3 + d4 AS dd, least(greatest(least(greatest(u / 100, 0.05), 0.5) / least(greatest(su / 100, 0.05), 0.5), 0.8), 1.2) AS use FROM e),
h AS (SELECT *, CASE WHEN abs(dd) > 1.5 THEN 1.5 / abs(dd) ELSE 1 END AS held, CASE WHEN player % 8 > 0 THEN 1 + player % 3 ELSE 0 END AS own, (CASE WHEN player % 8 > 0 THEN 1 ELSE 1.5 END) * 1.0625 * (1 + 0.15 * abs(st - dt)) * (CASE WHEN games < 15 THEN 1.15 ELSE 1 END) AS wide FROM g)
SELECT player, season, source, target, st::INT AS source_tier, dt::INT AS target_tier, round(neutral + dd * held, 6) AS value, round(neutral + dd * held - 1.2816 * greatest(sqrt(own * own + 0.25 * pow(6 / greatest(minutes, 1), 2) + pow(sd * 0.05, 2)) * wide, 0.1), 6) AS low,
  round(d1 * held, 6) AS role, round(d2 * held, 6) AS style, round(d3 * held, 6) AS roster, round(d4 * held, 6) AS tier, round(pts * use * minutes / 40, 6) AS pts_per_game FROM h""")
def c09b(spark, d):
    """Projected moves: tiers, neutral value by version, learned role change and tier effects, capped parts, interval, rescaled points."""
    m = io.stage(_pairs(spark, d), "destinations")
    role, tiers = D.fit_moves(m.where(F.col("season") < _FIRST).withColumn("change", F.col("gain") / 7), "gain", ["source_usage"], "change")
    out = D.project_destinations(m.where(F.col("season") >= _FIRST), role, tiers, {"shooting": (F.col("player") % 100).cast("double")}, {}, 0.05)
    parts = [r6(F.get("parts", F.lit(i)), n) for i, n in enumerate(D.PARTS)]
    return out.select("player", "season", "source", "target", F.col("source_tier").cast("int").alias("source_tier"), F.col("target_tier").cast("int").alias("target_tier"), r6("value"), r6("low"), *parts, r6(F.try_element_at("rates", F.lit("pts_per_game")), "pts_per_game"))
