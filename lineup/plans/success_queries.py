"""Transfer success: players' seasons (see ``opportunity_queries``) at another school than the season before are moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions.scalars import tier_cut
from lineup.operators import aggregates as A
from lineup.operators import extras as E
from lineup.operators import joins as J
from lineup.operators import opportunity as Q
from lineup.operators import success as U
from lineup.operators import windows as W
from lineup.plans.base import Registry, r6, table
from lineup.plans.opportunity_queries import _STATS, _stats
from lineup.sources import io

R = Registry()

_LEVELS = [[], ["position"], ["position", "band"], ["position", "band", "crowd"]]
_NAMES = ["overall", "position", "pair", "cell"]

_MOVES = f"""WITH s AS {_STATS}, tc AS (SELECT school, season + 1 AS season, sum(min_pct / 100 * 40) AS tm FROM s GROUP BY school, s.season),
v AS (SELECT n.player, n.season, b.school AS source, n.school AS target, n.position, 1 + (b.min_pct >= 40)::INT + (b.min_pct >= 70)::INT AS band, 1 + (coalesce(tm, 0) >= 60)::INT + (coalesce(tm, 0) >= 110)::INT AS crowd, b.usage_rate AS was, n.usage_rate AS now,
  CASE WHEN c_acctbal > 0 THEN 16 + c_acctbal / 1301 END AS projected FROM s b JOIN s n ON n.player = b.player AND n.season = b.season + 1 AND n.school <> b.school JOIN customer ON c_custkey = n.player LEFT JOIN tc ON tc.school = n.school AND tc.season = n.season),
m AS (SELECT *, CASE WHEN projected IS NOT NULL THEN now >= projected ELSE now >= was END AS success, CASE WHEN projected IS NOT NULL THEN 'projected' ELSE 'earlier' END AS rule FROM v)"""


def _moves(spark, d):
    """Moves with their cell, their projected and actual usage, and the label of success."""
    s = io.stage(_stats(spark, d), "seasons")
    now = s.select("player", "season", F.col("school").alias("target"), F.col("usage_rate").alias("now"))
    both = J.season_offset_join(s.select("player", "season", F.col("school").alias("source"), "position", "min_pct", F.col("usage_rate").alias("was")), now, ["player"], "season", 1)
    both = both.where("source <> target").withColumn("season", F.col("season") + 1)
    team = Q.team_context(s).select(F.col("school").alias("target"), "season", "prior_team_minutes")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player"), F.when(F.col("c_acctbal") > 0, 16 + F.col("c_acctbal") / 1301).alias("projected"))
    m = both.join(c, "player").join(team, ["target", "season"], "left")
    label, rule = E.success_label(F.col("now"), F.col("projected"), F.col("was"), F.col("now"))
    bands = {"band": tier_cut(F.col("min_pct"), [40.0, 70.0]), "crowd": tier_cut(F.coalesce("prior_team_minutes", F.lit(0.0)), [60.0, 110.0])}
    return m.withColumns({**bands, "success": label.cast("int"), "rule": rule})


def _scored(spark, d):
    m = io.stage(_moves(spark, d), "moves")
    scored = U.expanding_rates(m, "success", "season", _LEVELS)
    return scored.withColumns({"rate": U.shrunk_rate(len(_LEVELS)), "level": U.deciding_level(_NAMES)})


def _past(k: int, keys: list[str]) -> str:
    on = "".join(f" AND t.{c} IS NOT DISTINCT FROM m.{c}" for c in keys)
    return f"l{k} AS (SELECT m.player, m.season, coalesce(sum(pow(0.9, m.season - t.season)), 0) AS n, sum(pow(0.9, m.season - t.season) * t.success::INT) / sum(pow(0.9, m.season - t.season)) AS r FROM m LEFT JOIN m t ON t.season < m.season{on} GROUP BY 1, 2)"


def _chain(k: int) -> str:
    return "l0.r" if k == 0 else f"((l{k}.n * coalesce(l{k}.r, {_chain(k - 1)}) + 15 * {_chain(k - 1)}) / (l{k}.n + 15))"


_RATE = f"CASE WHEN l0.n > 0 THEN {_chain(3)} ELSE 0.5 END"
_COMPS = """h AS (SELECT *, row_number() OVER (PARTITION BY position, band, crowd, season ORDER BY player) AS place FROM m),
k AS (SELECT m.player, m.season, string_agg(h.player::VARCHAR, ',' ORDER BY h.season DESC, h.player) AS comps FROM m JOIN LATERAL (SELECT player, season FROM h WHERE h.position = m.position AND h.band = m.band AND h.crowd = m.crowd AND h.season < m.season AND place <= 3 ORDER BY season DESC, player LIMIT 3) h ON true GROUP BY 1, 2)"""


@R("C11b_transfer_success", f"""{_MOVES}, {', '.join(_past(k, keys) for k, keys in enumerate(_LEVELS))}, {_COMPS}
SELECT player, season, source, target, success::INT AS success, rule, round(rate, 6) AS rate, CASE {' '.join(f"WHEN l{k} THEN '{_NAMES[k]}'" for k in (3, 2, 1, 0))} ELSE 'bootstrap' END AS level,
 1 + (rate >= 0.35)::INT + (rate >= 0.5)::INT + (rate >= 0.65)::INT + (rate >= 0.8)::INT AS tier, coalesce(comps, '') AS comps
FROM (SELECT m.*, {_RATE} AS rate, {', '.join(f"l{k}.n > 0 AS l{k}" for k in range(4))}, comps FROM m {' '.join(f"JOIN l{k} ON l{k}.player = m.player AND l{k}.season = m.season" for k in range(4))} LEFT JOIN k ON k.player = m.player AND k.season = m.season)""")
def c11b(spark, d):
    """Moves with label, the shrunk rate of their cell in earlier seasons, its level and tier, and up to three earlier moves of the cell."""
    s = _scored(spark, d)
    history = s.where("position IS NOT NULL").select("position", "band", "crowd", "season", F.col("player").alias("item"))
    out = J.attach_comps(s, history, ["position", "band", "crowd"], "season", "item")
    comps = F.concat_ws(",", F.transform("comps", lambda x: x.cast("string")))
    return out.select("player", "season", "source", "target", "success", "rule", r6("rate"), "level", tier_cut(F.col("rate"), U.SUCCESS_CUTS).alias("tier"), comps.alias("comps"))


def adjusted_moves(spark, d):
    """Rates moved by how a player's earlier usage stands out in the season; each season's coefficient is fitted on the seasons before it."""
    s = io.stage(W.zscore_by(_scored(spark, d), "season", "was", "z").withColumn("offset", U.logit(F.col("rate"))), "scored")
    betas = U.expanding_beta(s, "success", "offset", "z", "season")
    return s.withColumn("probability", U.adjusted(F.col("rate"), F.col("z"), F.col("season"), betas))


@R("C11c_success_probability")
def c11c(spark, d):
    """Moves with the adjusted probability and its tier."""
    a = adjusted_moves(spark, d)
    return a.select("player", "season", "success", r6("rate"), r6("z"), r6("probability"), tier_cut(F.col("probability"), U.SUCCESS_CUTS).alias("tier"))


@R("C11d_success_calibration")
def c11d(spark, d):
    """Tiers with predicted and actual rates (empty tiers stay) and the expected calibration error."""
    a = io.stage(adjusted_moves(spark, d).where("n_0 > 0").withColumn("tier", tier_cut(F.col("probability"), U.SUCCESS_CUTS)), "adjusted")
    tiers = A.calibration(a, "success", "probability", "tier", [1, 2, 3, 4, 5])
    error = A.ece(a, "success", "probability")  # one row
    return tiers.crossJoin(F.broadcast(error)).select("tier", "n", r6("predicted"), r6("actual"), r6("gap"), r6("ece"))
