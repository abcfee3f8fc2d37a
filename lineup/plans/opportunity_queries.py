"""Playing time: customers are players, twelve neighbouring customers a school, order years are seasons; some seasons are played at the next school."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions import opportunity as O
from lineup.functions import playing as P
from lineup.functions.scalars import clip, rounded
from lineup.operators import extras as E
from lineup.operators import learn as L
from lineup.operators import opportunity as Q
from lineup.plans.base import Registry, r6, table
from lineup.sources import io

R = Registry()

_BOX = ["games_played", "points_per_game", "rebounds_per_game", "assists_per_game"]
_LABELS = ["player", "season", "school"]

_STATS = f"""(SELECT o_custkey AS player, year(o_orderdate) AS season, (o_custkey + CASE WHEN (o_custkey + year(o_orderdate)) % 6 = 0 THEN 12 ELSE 0 END) // 12 AS school,
  {list(P.POSITIONS) + ['G']}[(o_custkey % 7)::INT + 1] AS position, least(sum(o_totalprice) / 7919, 100) AS min_pct, least(8 + avg(o_totalprice) / 19997, 40) AS usage_rate,
  count(*)::DOUBLE AS games_played, max(o_totalprice) / 19997 AS points_per_game, min(o_totalprice) / 39989 AS rebounds_per_game, count_if(o_orderstatus = 'F')::DOUBLE AS assists_per_game
  FROM orders GROUP BY o_custkey, 2)"""


def _stats(spark, d):
    price = F.col("o_totalprice")
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")).agg(
        F.least(F.sum(price) / 7919, F.lit(100.0)).alias("min_pct"),
        F.least(8 + F.avg(price) / 19997, F.lit(40.0)).alias("usage_rate"),
        F.count("*").cast("double").alias("games_played"),
        (F.max(price) / 19997).alias("points_per_game"),
        (F.min(price) / 39989).alias("rebounds_per_game"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("assists_per_game"),
    )
    p, season = F.col("player"), F.col("season")
    school = F.floor((p + F.when((p + season) % 6 == 0, 12).otherwise(0)) / 12)
    return s.withColumns({"school": school, "position": F.get(F.array(*[F.lit(x) for x in (*P.POSITIONS, "G")]), (p % 7).cast("int"))})


def _frame(spark, d, stats):
    k, season = F.col("c_custkey"), F.col("season")
    c = table(spark, d, "customer")
    sure = [F.when(k % 9 > 0, (k * (n + 2) % 10) / 10).alias(name) for n, name in enumerate(O.CONFIDENCES)]
    facts = c.select(k.alias("player"), F.when(F.col("c_acctbal") > 0, 66 + F.floor(F.col("c_acctbal") / 500)).cast("double").alias("height_inches"), F.when(k % 4 > 0, (k % 10) / 10).alias("archetype_confidence"), *sure)
    value = F.col("c_acctbal") / 1000 + season - 1998
    known = stats.select(F.col("player").alias("c_custkey"), "season").join(c, "c_custkey").where(k % 11 > 0)
    projections = known.select(k.alias("player"), "season", F.when(F.col("c_mktsegment") == "BUILDING", "own season").otherwise("forecast").alias("version"), value.alias("value_per_100"), (value - 1 - k % 5).alias("value_ci_lower"), (value + 1 + k % 4).alias("value_ci_upper"))
    transfers = stats.where("player % 3 > 0").select("player", "season", "school", (0.5 + F.col("player") % 5 / 10).alias("match_confidence"))
    ratings = stats.groupBy("school", (season + 1).alias("season")).agg(F.avg(F.col("points_per_game") - F.col("rebounds_per_game")).alias("team_adj_em"), F.avg("points_per_game").alias("team_adj_o"), F.avg("rebounds_per_game").alias("team_adj_d"), F.avg("games_played").alias("team_adj_tempo"))
    return Q.opportunity_frame(stats, _BOX, facts, projections, transfers, ratings, "forecast")


_PLAYING = f"""WITH s AS {_STATS},
prev AS (SELECT player, season + 1 AS season, school AS was, position AS had, min_pct / 100 * 40 AS m, usage_rate AS u FROM s),
mv AS (SELECT s.school, s.season, s.position, CASE WHEN p.was = s.school THEN 'back' WHEN p.was IS NOT NULL THEN 'in' ELSE 'new' END AS kind, coalesce(p.m, 0) AS m, p.u FROM s LEFT JOIN prev p USING (player, season)
  UNION ALL SELECT p.was, p.season, p.had, 'out', p.m, p.u FROM prev p LEFT JOIN s USING (player, season) WHERE s.school IS DISTINCT FROM p.was),
f AS (SELECT school, season, position, sum(m) FILTER (kind = 'back') AS back, sum(m) FILTER (kind = 'out') AS gone, sum(m) FILTER (kind = 'in') AS came, greatest(40 - coalesce(sum(m) FILTER (kind = 'back'), 0), 0) AS opened, CASE WHEN count(u) FILTER (kind = 'out') > 0 THEN least(sum(u) FILTER (kind = 'out'), 100) END AS use FROM mv WHERE position IS NOT NULL GROUP BY ALL),
fm AS (SELECT school, season, avg(back) AS back, avg(gone) AS gone, avg(came) AS came, avg(opened) AS opened, avg(use) AS use FROM f GROUP BY ALL),
rt AS (SELECT school, season, count(*) FILTER (kind <> 'out') AS players, sum(m * u / 100) FILTER (kind = 'back') AS production, max(m * u / 100) FILTER (kind = 'back') AS impact FROM mv GROUP BY ALL),
tc AS (SELECT school, season + 1 AS season, sum(min_pct / 100 * 40) AS tm, sum(pow(min_pct / 100 * 40, 2)) / nullif(pow(sum(min_pct / 100 * 40), 2), 0) AS hhi, count_if(min_pct >= 50) AS rp, sum(usage_rate) AS tu, avg(points_per_game - rebounds_per_game) AS em, avg(points_per_game) AS o, avg(rebounds_per_game) AS dd, avg(games_played) AS tempo FROM s GROUP BY school, s.season),
pc AS (SELECT school, season + 1 AS season, position, sum(min_pct / 100 * 40) AS pm, max(min_pct / 100 * 40) AS px, count(*) AS pn, sum(usage_rate) AS pu, max(usage_rate) AS pmu FROM s WHERE position IS NOT NULL GROUP BY school, s.season, position),
h AS (SELECT player, season, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS past, min(season) OVER (PARTITION BY player) AS first FROM s),
x AS (SELECT s.player, s.season, s.school, s.position, b.min_pct AS pmin, b.usage_rate AS puse, b.games_played AS pg, b.points_per_game AS ppts, b.rebounds_per_game AS preb, b.assists_per_game AS past_a, h.past, h.first,
  CASE WHEN c_acctbal > 0 THEN 66 + floor(c_acctbal / 500) END AS height, CASE WHEN s.player % 4 > 0 THEN (s.player % 10) / 10 END AS arch, CASE WHEN s.player % 9 > 0 THEN {'greatest(' + ', '.join(f'(s.player * {n + 2} % 10) / 10' for n in range(5)) + ')'} END AS conf,
  CASE WHEN s.player % 11 > 0 AND c_mktsegment <> 'BUILDING' THEN c_acctbal / 1000 + s.season - 1998 END AS v, CASE WHEN s.player % 11 > 0 AND c_mktsegment <> 'BUILDING' THEN 2 + s.player % 5 + s.player % 4 END::DOUBLE AS width,
  (b.school IS NOT NULL AND b.school <> s.school)::INT::DOUBLE AS moved, coalesce(b.school = s.school, false)::INT::DOUBLE AS same, (s.player % 3 > 0)::INT::DOUBLE AS portal, CASE WHEN s.player % 3 > 0 THEN 0.5 + (s.player % 5) / 10 END AS conf_t,
  coalesce(f.back, fm.back) AS ret, coalesce(f.gone, fm.gone) AS gone, coalesce(f.came, fm.came) AS came, coalesce(f.opened, fm.opened, 0) AS opened, coalesce(f.use, fm.use) AS use,
  rt.players, rt.production, rt.impact, tc.tm, tc.hhi, tc.rp, tc.tu, tc.em, tc.o, tc.dd, tc.tempo, pc.pm, pc.px, pc.pn, pc.pu, pc.pmu
 FROM s JOIN customer ON c_custkey = s.player JOIN h ON h.player = s.player AND h.season = s.season LEFT JOIN s b ON b.player = s.player AND b.season = s.season - 1
 LEFT JOIN f ON f.school = s.school AND f.season = s.season AND f.position = s.position LEFT JOIN fm ON fm.school = s.school AND fm.season = s.season
 LEFT JOIN rt ON rt.school = s.school AND rt.season = s.season LEFT JOIN tc ON tc.school = s.school AND tc.season = s.season LEFT JOIN pc ON pc.school = s.school AND pc.season = s.season AND pc.position = s.position)
"""
# every feature in SQL, by name
_B, _G, _C, _M = "coalesce(ret, 0)", "coalesce(gone, 0)", "coalesce(came, 0)", "coalesce(pmin, 0) / 100 * 40"
_SAID = {
    "prior_minutes": _M,
    "prior_minutes_share": "coalesce(pmin, 0) / 100",
    "projection_ci_width": "width",
    "prior_college_seasons": "past",
    "is_no_prior_college_season": "(past = 0)::INT",
    "career_season_index": "least(past + 1, 8)",
    "years_since_first_observed": "least(season - first, 8)",
    **{f"position_is_{p.lower()}": f"coalesce(position = '{p}', false)::INT" for p in P.POSITIONS},
    **{f"position_group_{g}": f"coalesce(position IN ({', '.join(repr(x) for x in of)}, '-'), false)::INT" for g, of in O.POSITION_GROUPS.items()},
    "position_confidence": "coalesce(conf, 0.5)",
    "archetype_confidence": "coalesce(arch, 0.45)",
    "is_transfer": "moved",
    "candidate_changes_school": "moved",
    "is_portal_candidate": "portal",
    "transfer_match_confidence": "coalesce(conf_t, CASE WHEN moved = 1 THEN 0.5 ELSE 1 END)",
    "same_school_baseline": "same",
    "roster_open_minutes": "opened",
    "returning_minutes_position": "ret",
    "departing_minutes_position": "gone",
    "incoming_transfer_minutes_position": "came",
    "open_usage_position": "use",
    "position_opportunity_delta": f"{_G} + {_C} - {_B}",
    "returning_minutes_share_position": f"least({_B} / 100, 5)",
    "open_minutes_share_position": "least(opened / 100, 5)",
    "same_position_minutes_mean": "coalesce(pm / pn, 0)",
    "same_position_usage_mean": "coalesce(pu / pn, 0)",
    "prior_team_minutes_mean": "coalesce(tm / nullif(rp, 0), 0)",
    "returning_production_per_rotation_player": "coalesce(production / nullif(rp, 0), 0)",
    "position_crowding_ratio": f"least({_B} / greatest(opened, 1), 10)",
    "opportunity_to_prior_minutes_ratio": f"least(opened * 0.4 / greatest({_M}, 1), 20)",
    "open_minutes_minus_returning_position": f"opened - {_B}",
    "departing_minus_incoming_transfer_minutes": f"{_G} - {_C}",
    "sample_reliability": "least(coalesce(pg, 0) / 20, 1) * sqrt(least(coalesce(pmin, 0) / 55, 1))",
    "projection_reliability": "greatest(8 / (8 + coalesce(width, 8)), 0.2)",
    "roster_reliability": "CASE WHEN players IS NULL THEN 0.45 ELSE 0.9 END",
    "value_per_100": "v",
    "prior_usage_rate": "puse",
    "prior_games_played": "pg",
    "prior_points_per_game": "ppts",
    "prior_rebounds_per_game": "preb",
    "prior_assists_per_game": "past_a",
    "height_inches": "height",
    "team_adj_em": "em",
    "team_adj_o": "o",
    "team_adj_d": "dd",
    "team_adj_tempo": "tempo",
    "roster_player_count": "players",
    "prior_team_usage_total": "tu",
    "prior_team_minutes": "tm",
    "prior_team_rotation_hhi": "hhi",
    "prior_team_rotation_players": "rp",
    "same_position_usage_total": "pu",
    "same_position_usage_max": "pmu",
    "same_position_prior_minutes": "pm",
    "same_position_prior_max_minutes": "px",
    "same_position_prior_count": "pn",
    "returning_production": "production",
    "returning_player_impact": "impact",
}
#: Counts and flags beside those that are named so: whole numbers, which rounding leaves as they are.
_WHOLE = {"prior_college_seasons", "career_season_index", "years_since_first_observed", "candidate_changes_school", "same_school_baseline", "prior_games_played", "roster_player_count", "prior_team_rotation_players", "same_position_prior_count"}


@R("P61b_opportunity_frame", _PLAYING + f"""SELECT player, season, school, {', '.join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in _SAID.items())}, {' + '.join(f"({e} IS NULL)::INT" for e in _SAID.values() if e.isidentifier())} AS missing_feature_count FROM x""")
def p61b(spark, d):
    """Every feature of every player's season, with the contexts that they are made of."""
    f = _frame(spark, d, io.stage(_stats(spark, d), "seasons"))
    whole = lambda n: n.startswith(("position_is_", "position_group_", "is_")) or n in _WHOLE
    return f.select(*_LABELS, *[n if whole(n) else rounded(F.col(n), 6).alias(n) for n in _SAID], "missing_feature_count")


@R("C08_playing_time")
def c08(spark, d):
    """Features of every player's season (J01, P20, P61), boosted minutes and usage, conformal intervals by career season, usage drawn to the
    opening of the position, role, role fit, and the fits written into the stored ones (S12): a pair that is stored keeps its gap match."""
    f = _frame(spark, d, io.stage(_stats(spark, d), "seasons")).withColumns({"share": F.least(F.col("min_pct") / 100, F.lit(1.0)), "stage": F.least("prior_college_seasons", F.lit(2.0))})
    f = io.stage(f, "playing-time")
    run = L.staged_boosting(f.where("season < 1999"), list(_SAID), "share", "usage_rate", rounds=3, depth=3)
    keep = ["player", "school", "season", "stage", "share", "open_usage_position", "roster_reliability", "roster_open_minutes", "roster_player_count", "sample_reliability", "p_rotation", "p_starter", "expected_share", "expected_usage"]
    held, ahead = (io.stage(run(f.where(c)).select(*keep), "playing-run") for c in ("season = 1999", "season > 1999"))
    out = L.conformal_interval(held, ahead, "share", "expected_share", ["stage"])
    use = P.usage_budget(F.col("expected_usage"), F.col("open_usage_position"), F.col("roster_reliability"), F.col("p_rotation"), F.col("expected_share"))
    held_in = lambda c: clip(F.col(c), 0.0, 1.0)
    out = out.withColumns({"low": held_in("low"), "high": held_in("high")})
    out = out.withColumns({"expected_usage": use, "minutes": F.col("expected_share") * O.GAME_MINUTES, "width": (F.col("high") - F.col("low")) * O.GAME_MINUTES})
    role = P.usage_role(F.col("expected_usage"), F.col("minutes"), F.lit(""), F.create_map().cast("map<string,double>"), F.col("sample_reliability"))
    fit = P.role_fit_score(F.col("minutes"), F.col("expected_usage"), F.col("width"), F.col("roster_player_count"), F.col("roster_open_minutes"), F.col("p_rotation"), F.col("p_starter"))
    fresh = out.select("player", "school", "season", fit.alias("role_fit"), role["role"].alias("role"), r6("expected_share"), r6("expected_usage"), r6("low"), r6("high"))
    stored = f.where("season > 1999 AND player % 2 = 0").select("player", "school", "season", (40 + F.col("player") % 21).cast("double").alias("gap_match"), *[F.lit(None).cast("double").alias(c) for c in ("role_fit", "expected_share", "expected_usage", "low", "high")], F.lit(None).cast("string").alias("role"))
    return E.upsert_partial(stored, fresh, ["player", "school", "season"], ["role_fit", "role", "expected_share", "expected_usage", "low", "high"], {"gap_match": 50.0})
