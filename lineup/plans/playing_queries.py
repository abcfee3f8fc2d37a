"""Position, role, style, uncertainty and roster queries: customers are candidates, suppliers are schools, their line items' lines are members."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions import playing as P
from lineup.operators import models as M
from lineup.operators import rosters as T
from lineup.plans.base import Registry, r6, table
from lineup.sources.io import stage

R = Registry()


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in values) + "]::DOUBLE[]"


_ROLES = [k.upper() for k in P.ROLE_WEIGHTS]
_SOFT_SQL = f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN [c_custkey % 5, c_custkey % 3, (c_custkey % 8) / 4, 0, c_custkey % 2]::DOUBLE[] END AS m,
  CASE WHEN c_custkey % 3 = 0 THEN list_extract({_ROLES}, (c_custkey % 10)::INT + 1) END AS role,
  CASE WHEN c_custkey % 7 < 5 THEN list_extract({list(P.POSITIONS)}, (c_custkey % 7)::INT + 1) ELSE 'G' END AS position,
  CASE WHEN c_acctbal > 0 THEN 66 + floor(c_acctbal / 500) END AS height FROM customer"""
_SOFT_SQL = f"""WITH x AS ({_SOFT_SQL}),
s AS (SELECT *, CASE WHEN coalesce(list_sum(m), 0) >= 1e-6 THEN 'model' WHEN role IS NOT NULL THEN 'role' WHEN position <> 'G' THEN 'position' WHEN height IS NOT NULL THEN 'height' ELSE 'uniform' END AS source FROM x),
w AS (SELECT *, CASE source WHEN 'model' THEN m WHEN 'role' THEN CASE lower(role) {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in P.ROLE_WEIGHTS.items())} END
  WHEN 'position' THEN list_transform({list(P.POSITIONS)}, lambda p: (p = position)::INT::DOUBLE)
  WHEN 'height' THEN CASE {' '.join(f"WHEN height <= {h} THEN {_list(v)}" for h, v in P.HEIGHT_WEIGHTS if h)} ELSE {_list(P.HEIGHT_WEIGHTS[-1][1])} END ELSE {_list([0.2] * 5)} END AS w FROM s)
"""


@R("P39_soft_positions", _SOFT_SQL + f"""SELECT c_custkey, source, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.SOURCE_RELIABILITY.items())} END::DOUBLE AS reliability,
{', '.join(f"round(w[{k + 1}] / list_sum(w), 6) AS {p.lower()}" for k, p in enumerate(P.POSITIONS))} FROM w""")
def p39(spark, d):
    s = _soft(spark, d).select("c_custkey", "s.*")
    return s.select("c_custkey", "source", "reliability", *[r6(F.col("weights")[k], p.lower()) for k, p in enumerate(P.POSITIONS)])


def _soft(spark, d):
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    model = F.when(F.col("c_custkey") % 4 == 0, F.array(*[x.cast("double") for x in (F.col("c_custkey") % 5, F.col("c_custkey") % 3, (F.col("c_custkey") % 8) / 4, F.lit(0), F.col("c_custkey") % 2)]))
    role = F.when(F.col("c_custkey") % 3 == 0, pick(_ROLES, F.col("c_custkey") % 10))
    position = F.when(F.col("c_custkey") % 7 < 5, pick(P.POSITIONS, F.col("c_custkey") % 7)).otherwise("G")
    return table(spark, d, "customer").select("c_custkey", P.soft_positions(model, role, position, F.when(F.col("c_acctbal") > 0, 66 + F.floor(F.col("c_acctbal") / 500))).alias("s"))


_IN = "SELECT c_custkey, (c_acctbal + 1000) / 275 AS m, 6 + (c_custkey % 26)::DOUBLE AS u, (c_custkey % 21)::DOUBLE AS width, 9 + (c_nationkey % 9)::DOUBLE AS players, abs(c_acctbal) / 45 AS open, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 101) / 100 END AS rotation, (c_custkey % 71) / 70 AS starter, CASE WHEN c_custkey % 6 > 0 THEN (c_nationkey % 10) / 10 END AS reliable, c_mktsegment FROM customer"


def _in(spark, d):
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey",
        ((F.col("c_acctbal") + 1000) / 275).alias("m"),
        (6 + (F.col("c_custkey") % 26)).cast("double").alias("u"),
        (F.col("c_custkey") % 21).cast("double").alias("width"),
        (9 + n % 9).cast("double").alias("players"),
        (F.abs(F.col("c_acctbal")) / 45).alias("open"),
        F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 101) / 100).alias("rotation"),
        ((F.col("c_custkey") % 71) / 70).alias("starter"),
        F.when(F.col("c_custkey") % 6 > 0, (n % 10) / 10).alias("reliable"),
        "c_mktsegment",
    )


def _role_fit_sql(m: str, u: str) -> str:
    hold = lambda x, a, b: f"least(greatest({x}, {a}), {b})"
    path = f"65 * {hold(f'coalesce(rotation, {m} / 28)', 0, 1)} + 35 * {hold('starter', 0, 1)}"
    gain = f"0.48 * {hold(f'{m} / 28 * 100', 0, 100)} + 0.22 * {hold(path, 0, 100)} + 0.18 * {hold(f'100 - abs({u} - 20) * 2', 40, 100)} + 0.12 * {hold('least(open, 200) / 80 * 100', 35, 100)}"
    return hold(f"{gain} - {hold('width / 16 * 18', 0, 25)} - {hold('greatest(players - 12, 0) * 1.25', 0, 15)}", 0, 100)


def _role_fit(m, u):
    return P.role_fit_score(m, u, F.col("width"), F.col("players"), F.col("open"), F.col("rotation"), F.col("starter"), digits=6)


@R("P42_role_fit_score", f"SELECT c_custkey, round({_role_fit_sql('m', 'u')}, 6) AS role_fit FROM ({_IN})")
def p42(spark, d):
    return _in(spark, d).select("c_custkey", _role_fit(F.col("m"), F.col("u")).alias("role_fit"))


@R("P52_what_if_minutes", f"SELECT c_custkey, round(least(greatest(60 + {_role_fit_sql('(m / 2)', '(u + 3)')} - {_role_fit_sql('m', 'u')}, 0), 100), 6) AS role_fit FROM ({_IN})")
def p52(spark, d):
    """Half the minutes and more usage: the stored score moves by the difference."""
    m, u = F.col("m"), F.col("u")
    return _in(spark, d).select("c_custkey", r6(P.what_if_role_fit(F.lit(60.0), _role_fit(m, u), _role_fit(m / 2, u + 3)), "role_fit"))


_SEGMENT = {"AUTOMOBILE": "Shooting wing", "BUILDING": "Big rim", "FURNITURE": "Playmaker", "HOUSEHOLD": "Defender"}
_LABEL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in _SEGMENT.items()) + " ELSE '' END"
_RULES = [
    ("primary_creator", "u >= 25 AND m >= 24", 3.0), ("secondary_creator", "u >= 20", 2.0), ("connector", "u BETWEEN 14 AND 22", 1.5), ("play_finisher", "u BETWEEN 14 AND 22", 1.0), ("depth", "u < 15 OR m < 10", 2.0),
    ("spacing_specialist", "contains(label, 'shoot') OR shooting >= 65", 2.5), ("primary_creator", "contains(label, 'playmaker') OR passing >= 65", 1.5), ("secondary_creator", "contains(label, 'playmaker') OR passing >= 65", 1.5),
    ("rim_runner_rebounder", "contains(label, 'big')", 2.5), ("defensive_specialist", "contains(label, 'def') OR block >= 70", 2.0), ("depth", "m >= 18", -1.5),
]
_SCORES = ", ".join("(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for n, c, v in _RULES if n == role) + ")::DOUBLE" for role in P.USAGE_ROLES)


@R("P44_usage_role", f"""WITH x AS (SELECT *, {_LABEL} AS label, (c_custkey % 90)::DOUBLE AS shooting, (c_custkey % 77)::DOUBLE AS passing, (c_custkey % 83)::DOUBLE AS block FROM ({_IN})),
s AS (SELECT c_custkey, [{_SCORES}] AS s, coalesce(reliable, 0) AS rel FROM x),
t AS (SELECT *, list_max(s) AS top, list_reverse_sort(s)[2] AS second FROM s)
SELECT c_custkey, {list(P.USAGE_ROLES)}[list_position(s, top)] AS role, round(least(greatest(0.45 + 0.12 * (top - second) + 0.2 * rel, 0.25), 0.95), 6) AS confidence FROM t""")
def p44(spark, d):
    label = F.create_map(*[x for k, v in _SEGMENT.items() for x in (F.lit(k), F.lit(v))])[F.col("c_mktsegment")]
    skills = F.create_map(F.lit("shooting_3p"), (F.col("c_custkey") % 90).cast("double"), F.lit("passing_creation"), (F.col("c_custkey") % 77).cast("double"), F.lit("block_rim_protection"), (F.col("c_custkey") % 83).cast("double"))
    return _in(spark, d).select("c_custkey", P.usage_role(F.col("u"), F.col("m"), label, skills, F.col("reliable")).alias("r")).select("c_custkey", "r.role", r6("r.confidence", "confidence"))


@R("P48_usage_budget", f"SELECT c_custkey, round(greatest(u - CASE WHEN coalesce(reliable, 0) >= 0.6 AND width > 0 THEN greatest(u - width, 0) * 0.6 * (1 - 0.5 * least(coalesce(rotation, 0.5) * starter, 1)) ELSE 0 END, 0), 6) AS usage FROM ({_IN})")
def p48(spark, d):
    return _in(spark, d).select("c_custkey", r6(P.usage_budget(F.col("u"), F.when(F.col("width") > 0, F.col("width")), F.col("reliable"), F.col("rotation"), F.col("starter")), "usage"))


_SKILLS = ("shooting", "passing", "creation", "block", "off_reb", "def_reb")
_PCT = ", ".join(f"CASE WHEN c_custkey % {7 + k} > 0 THEN (c_custkey % {89 + 2 * k})::DOUBLE ELSE 50 END AS {s}" for k, s in enumerate(_SKILLS))
_OPEN = "least(greatest((0.25 - least(greatest(u / 100, 0), 0.35)) / 0.25, 0), 1)"


@R("P49_style_interactions", f"""WITH x AS (SELECT *, {_PCT} FROM ({_IN}))
SELECT c_custkey, round(least(greatest((shooting - 50) / 50 * coalesce(reliable, 0.35) * 0.12 + (passing - 50) / 50 * {_OPEN} * 0.10 - (creation - 50) / 50 * starter * 0.10
 + (block - 50) / 50 * least(players / 15, 1) * 0.09 + (off_reb - 50) / 50 * least(greatest(starter - 0.3, 0), 0.4) / 0.4 * 0.08 + (def_reb - 50) / 50 * coalesce(rotation, 0) * 0.07, -0.5), 0.5), 6) AS delta FROM x""")
def p49(spark, d):
    skills = {s: F.when(F.col("c_custkey") % (7 + k) > 0, (F.col("c_custkey") % (89 + 2 * k)).cast("double")) for k, s in enumerate(_SKILLS)}
    team = {"threes": F.col("reliable"), "crowding": F.col("starter"), "rim_need": F.col("players") / 15, "rim_share": F.col("starter"), "frontcourt_need": F.col("rotation")}
    return _in(spark, d).select("c_custkey", r6(P.style_interactions(skills, team, F.col("u") / 100), "delta"))


@R("P50_uncertainty_propagation", f"""WITH x AS (SELECT *, (CASE WHEN players > 14 THEN 1.5 ELSE 1 END) * (1 + 0.25 * (1 - coalesce(reliable, 0.75))) * (1 + 0.15 * least(c_custkey % 5, 3)) * (CASE WHEN u < 15 THEN 1.15 ELSE 1 END) * 1.1 AS wide FROM ({_IN})),
y AS (SELECT *, 1.2816 * greatest(sqrt((width / 2) ** 2 + 0.25 * (players / greatest(m, 1)) ** 2 + 0.49) * wide, 0.1) AS half FROM x)
SELECT c_custkey, round(m - half, 6) AS low, round(m + half, 6) AS high, round(wide, 6) AS multiplier FROM y""")
def p50(spark, d):
    m, w = F.col("m"), F.col("width")
    got = P.propagate_uncertainty(m, m - w / 2, m + w / 2, m, F.col("players"), 0.7, F.col("players") > 14, F.col("reliable"), F.col("c_custkey") % 5, F.col("u"), 1.1)
    return _in(spark, d).select("c_custkey", got.alias("g")).select("c_custkey", r6("g.low", "low"), r6("g.high", "high"), r6("g.multiplier", "multiplier"))


@R("P51_rescale_rates", f"""WITH x AS (SELECT *, least(greatest(u / 100, 0.05), 0.5) AS own FROM ({_IN})),
y AS (SELECT *, least(greatest(own / least(greatest(starter, 0.05), 0.5), 0.8), 1.2) AS f, least(greatest(((c_custkey % 90) - 50) / 50 * least(greatest((0.25 - least(own, 0.35)) / 0.25, 0), 1) * 0.1, -0.08), 0.08) AS ctx, c_custkey % 3 = 0 AS big FROM x)
SELECT c_custkey, u * f * m / 40 AS pts_per_game, width * least(greatest(1 + 0.5 * (f - 1) + ctx, 0.85), 1.15) * m / 40 AS ast_per_game, players * least(greatest(1 + 0.75 * (f - 1), 0.85), 1.2) * m / 40 AS tov_per_game,
u * CASE WHEN big THEN 1 + 0.08 * coalesce(rotation, 0) ELSE 1 END * m / 40 AS oreb_per_game, u * CASE WHEN big THEN 1 + 0.08 * coalesce(reliable, 0) ELSE 1 END * m / 40 AS blk_per_game, u * m / 40 AS fga_per_game FROM y""")
def p51(spark, d):
    stats = {"pts": "u", "ast": "width", "tov": "players", "oreb": "u", "blk": "u", "fga": "u"}
    rates = F.create_map(*[x for k, c in stats.items() for x in (F.lit(f"{k}_per_40"), F.col(c))])
    factors = P.box_factors(F.col("u") / 100, F.col("starter"), (F.col("c_custkey") % 90).cast("double"), F.col("c_custkey") % 3 == 0, F.col("rotation"), F.col("reliable"))
    rows = _in(spark, d).select("c_custkey", P.rescale_rates(rates, factors, F.col("m"), digits=None).alias("r"))
    return rows.select("c_custkey", *[F.col("r")[f"{k}_per_game"].alias(f"{k}_per_game") for k in stats])


@R("P56_kalman_uncertainty", f"""SELECT c_custkey, round(sqrt(width), 6) AS std, round(CASE WHEN u + players > 0 THEN u / (u + players) ELSE 0 END, 6) AS process_share, round(players / (width + players), 6) AS confidence,
CASE WHEN players / (width + players) >= 0.75 THEN 'high' WHEN players / (width + players) >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM ({_IN})""")
def p56(spark, d):
    k = P.kalman_uncertainty(F.col("width"), F.col("u"), F.col("players"))
    return _in(spark, d).select("c_custkey", k.alias("k")).select("c_custkey", "k.std", "k.process_share", "k.confidence", "k.label")


@R("P60_design_matrix", f"""SELECT c_custkey, coalesce(rotation, 0.5) AS rotation, m, 0.0::DOUBLE AS absent, {', '.join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS c_mktsegment_{s}" for s in ('BUILDING', 'MACHINERY', 'OTHER'))} FROM ({_IN})""")
def p60(spark, d):
    rows = _in(spark, d)
    return rows.select("c_custkey", *P.design_matrix(rows, ["rotation", "m", "absent"], {"c_mktsegment": ["BUILDING", "MACHINERY", "OTHER"]}, {"rotation": 0.5}))


@R("P61_prepare_opportunity_features", f"""SELECT c_custkey, round(least(m * 2 / 100, 1), 6) AS prior_minutes_share, round(CASE WHEN open > 0 THEN width / open ELSE 0 END, 6) AS open_share_position, round(CASE WHEN players + width > 0 THEN players / (players + width) ELSE 0 END, 6) AS position_competition,
round(u - coalesce(reliable, 0), 6) AS usage_gap, round(least(m * 2 / 100, 1) * 40 * starter, 6) AS minutes_at_stake, (m <= 0)::INT::DOUBLE AS is_newcomer, (reliable IS NULL)::INT AS missing_count FROM ({_IN})""")
def p61(spark, d):
    given = {"prior_min_pct": F.col("m") * 2, "open_minutes_position": F.col("width"), "open_minutes": F.col("open"), "returning_minutes_position": F.col("players"), "prior_usage": F.col("u"), "open_usage_position": F.col("reliable"), "position_confidence": F.col("starter"), "prior_games": F.col("m")}
    f = P.opportunity_features(given)
    return _in(spark, d).select("c_custkey", *[r6(f[n], n) for n in ("prior_minutes_share", "open_share_position", "position_competition", "usage_gap", "minutes_at_stake", "is_newcomer")], f["missing_count"].alias("missing_count"))


# rosters
_ROSTER = f"""r AS (SELECT l_suppkey AS school, l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS member, round(sum(l_quantity) / 1000, 6) AS min_pct,
  CASE WHEN (l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) % 4 > 0 THEN round(avg(l_discount) * 40 - 2, 6) END AS off, round(avg(l_tax) * 40 - 1.6, 6) AS deff, round(avg(l_discount) * 5, 6) AS three, round(avg(l_tax) * 5, 6) AS oreb, round(avg(l_quantity), 6) AS usage
  FROM lineitem GROUP BY 1, 2, l_linenumber, l_returnflag),
m AS (SELECT r.* REPLACE (CASE WHEN member % 6 > 0 THEN three END AS three), {list(P.POSITIONS)}[member % 5 + 1] AS position, s_nationkey % 4 + 1 AS tier, off IS NOT NULL AS known FROM r JOIN supplier ON s_suppkey = school),
b AS (SELECT tier, position, avg(off) AS off, avg(deff) AS deff, avg(coalesce(three, 0.3)) AS three, avg(oreb) AS oreb, avg(usage) AS usage FROM m WHERE off IS NOT NULL GROUP BY 1, 2)"""


def _members(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    mean = lambda c, a, b: F.round(F.avg(c) * a + b, 6)
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("school"), (F.col("l_linenumber") * 3 + flag).cast("bigint").alias("member"))
    r = r.agg(F.round(F.sum("l_quantity") / 1000, 6).alias("min_pct"), mean("l_discount", 40, -2).alias("off"), mean("l_tax", 40, -1.6).alias("deff"), mean("l_discount", 5, 0).alias("three"), mean("l_tax", 5, 0).alias("oreb"), mean("l_quantity", 1, 0).alias("usage"))
    r = r.withColumns({"off": F.when(F.col("member") % 4 > 0, F.col("off")), "three": F.when(F.col("member") % 6 > 0, F.col("three")), "position": F.get(F.array(*[F.lit(p) for p in P.POSITIONS]), (F.col("member") % 5).cast("int"))})
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("school"), (F.col("s_nationkey") % 4 + 1).alias("tier"))
    return r.join(s, "school").withColumn("known", F.col("off").isNotNull())


@R("A21_slot_baselines", f"WITH {_ROSTER} SELECT tier, position, round(off, 6) AS off, round(deff, 6) AS deff, round(three, 6) AS three, round(oreb, 6) AS oreb, round(usage, 6) AS usage FROM b")
def a21(spark, d):
    return T.slot_baselines(_members(spark, d)).select("tier", "position", *[r6(c) for c in T.SLOT_DEFAULTS])


def _filled(spark, d):
    m = stage(_members(spark, d), "members")
    return T.slot_fill(m, T.slot_baselines(m))


def _context(spark, d):
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("school"), (F.col("s_suppkey") % 5 / 10 + 0.4).alias("returning_share"), (n % 4 + 1).alias("tier"), F.when(n != 3, 62.0 + n % 12).alias("tempo"))


_FILLED = _ROSTER + """,
f AS (SELECT m.* REPLACE (coalesce(m.off, b.off) AS off, coalesce(m.three, b.three) AS three) FROM m LEFT JOIN b ON b.tier = m.tier AND b.position = m.position)"""
_CONTEXT = "ctx AS (SELECT s_suppkey AS school, s_suppkey % 5 / 10 + 0.4 AS returning_share, s_nationkey % 4 + 1 AS tier, CASE WHEN s_nationkey <> 3 THEN 62.0 + s_nationkey % 12 ELSE 68.0 END AS tempo FROM supplier)"


def _vector_sql(rows: str, key: str) -> str:
    return f"""SELECT {key}, sum(off * share) AS weighted_off, sum(deff * share) AS weighted_def, max(CASE WHEN rk = 1 THEN off END) AS top1_off, max(CASE WHEN rk = 2 THEN off END) AS top2_off, coalesce(sum(CASE WHEN rk >= 8 THEN off * share END), 0) AS bench_off,
 sum(three * share) AS three_coverage, coalesce(sum(CASE WHEN position IN ('PF', 'C') THEN deff * share END), 0) AS rim_protection, coalesce(sum(CASE WHEN position = 'PG' THEN off * share END), 0) AS pg_creation, sum(oreb * share) AS rebounding,
 sum((usage * share) ** 2) / sum(usage * share) ** 2 AS usage_hhi, count(*) FILTER (known)::DOUBLE AS n_known
 FROM (SELECT *, min_pct / sum(min_pct) OVER (PARTITION BY {key}) AS share, row_number() OVER (PARTITION BY {key} ORDER BY min_pct DESC, member) AS rk FROM {rows}) GROUP BY {key}"""


_OUT = ("weighted_off", "weighted_def", "top1_off", "top2_off", "bench_off", "three_coverage", "rim_protection", "pg_creation", "rebounding", "usage_hhi", "n_known")


@R("A22_roster_vector", f"WITH {_FILLED}, {_CONTEXT}, v AS ({_vector_sql('f', 'school')}) SELECT school, {', '.join(f'round({c}, 6) AS {c}' for c in _OUT)}, round(returning_share, 6) AS returning_share, tempo::DOUBLE AS tempo FROM v JOIN ctx USING (school)")
def a22(spark, d):
    rows = _filled(spark, d).drop("tier").join(_context(spark, d), "school")
    return T.roster_vector(rows, "school").select("school", *[r6(c) for c in _OUT], r6("returning_share"), "tempo")


_BASE_PCT, _DISCOUNT = {1: 12.0, 2: 10.0, 3: 9.0, 4: 8.0}, {1: 0.7, 2: 0.6, 3: 0.55, 4: 0.5}


@R("P59_freshman_prior_rows", f"""WITH {_ROSTER},
s AS (SELECT s_suppkey AS school, s_nationkey % 4 + 1 AS tier, (s_suppkey % 4)::INT AS n, s_suppkey % 9 = 0 AS elite, greatest(s_acctbal / 100, 0) AS pg, (s_suppkey % 50)::DOUBLE AS c FROM supplier),
o AS (SELECT *, CASE WHEN pg > 0 AND c > 0 THEN CASE WHEN pg >= c THEN ['PG', 'C'] ELSE ['C', 'PG'] END WHEN pg > 0 THEN ['PG'] WHEN c > 0 THEN ['C'] ELSE {list(P.POSITIONS)} END AS ranked,
  least([12.0, 10.0, 9.0, 8.0][tier] * CASE WHEN elite THEN 1.25 ELSE 1 END, 60) AS each, CASE WHEN elite THEN least([0.7, 0.6, 0.55, 0.5][tier] + 0.1, 0.9) ELSE [0.7, 0.6, 0.55, 0.5][tier] END AS less FROM s WHERE n > 0),
x AS (SELECT *, unnest(range(n)) AS idx FROM o), y AS (SELECT *, ranked[idx % len(ranked) + 1] AS position FROM x)
SELECT school, idx::INT AS idx, y.position, round(least(n * each, 60) / n * least(greatest(CASE y.position WHEN 'PG' THEN pg WHEN 'C' THEN c ELSE 0 END / 40, 0.5), 1.5), 6) AS min_pct, round(b.off * less, 6) AS off, round(b.deff * less, 6) AS deff FROM y LEFT JOIN b ON b.tier = y.tier AND b.position = y.position""")
def p59(spark, d):
    s = F.col("s_suppkey")
    schools = table(spark, d, "supplier").select(s.alias("school"), (F.col("s_nationkey") % 4 + 1).alias("tier"), (s % 4).cast("int").alias("freshmen"), (s % 9 == 0).alias("elite"), F.create_map(F.lit("PG"), F.greatest(F.col("s_acctbal") / 100, F.lit(0.0)), F.lit("C"), (s % 50).cast("double")).alias("open_minutes"))
    rows = T.freshman_rows(schools, T.slot_baselines(_members(spark, d)), _BASE_PCT, _DISCOUNT)
    return rows.select("school", "idx", "position", r6("min_pct"), r6("off"), r6("deff"))


_OFF = {"features": list(T.ROSTER_FEATURES), "coef": [0.9, 0.1, 0.3, 0.2, 0.4, 1.5, 0.05, 0.6, 0.8, -2.0, 1.2, 0.02, -1.1, 0.05], "intercept": 100.0}
_DEF = {"features": list(T.ROSTER_FEATURES), "coef": [-0.1, -0.8, -0.05, -0.04, -0.1, -0.2, -0.9, -0.05, -0.3, 0.5, -0.7, -0.01, 0.9, 0.02], "intercept": 98.0}
_PAIR = "p AS (SELECT s_suppkey * 5 + r_regionkey AS pair, s_suppkey AS school, 4.0 + 5 * r_regionkey AS minutes, (4.0 + 5 * r_regionkey) * 0.9 AS displaced, s_acctbal / 1000 AS value, CASE WHEN r_regionkey > 0 THEN 'C' ELSE 'SG' END AS pos FROM supplier, region)"


def _team_pairs(spark, d):
    pairs = table(spark, d, "supplier").crossJoin(F.broadcast(table(spark, d, "region")))  # five regions
    g = F.col("r_regionkey")
    return pairs.select((F.col("s_suppkey") * 5 + g).alias("pair"), F.col("s_suppkey").alias("school"), (4.0 + 5 * g).alias("minutes"), ((4.0 + 5 * g) * 0.9).alias("displaced"), (F.col("s_acctbal") / 1000).alias("value"), F.when(g > 0, "C").alias("cand_position"), F.lit(None).cast("double").alias("cand_three"), F.lit(0.25).alias("cand_oreb"), F.lit(22.0).alias("cand_usage"))


def _dot_sql(model, prefix):
    return " + ".join(f"({c}) * {prefix}{f}" for f, c in zip(model["features"], model["coef"], strict=True) if f not in ("tier", "tempo", "returning_share"))


def _part_sql(model, fs, sign=""):
    return f"round({sign}(" + " + ".join(f"({dict(zip(model['features'], model['coef'], strict=True))[f]}) * (a.{f} - b.{f})" for f in fs) + "), 6)"


@R("M24_counterfactual", f"""WITH {_FILLED}, {_PAIR}, {_CONTEXT}, v AS ({_vector_sql('f', 'school')}),
g AS (SELECT pair, f.*, displaced / 2 AS give, coalesce(sum(min_pct) OVER (PARTITION BY pair ORDER BY min_pct, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN f USING (school)),
h AS (SELECT pair, member, min_pct - least(min_pct, greatest(0, give - before)) AS min_pct, position, off, deff, three, oreb, usage, known FROM g
  UNION ALL SELECT pair, -1, minutes / 2, pos, value * 0.55, value * 0.45, 0.35, 0.25, 22.0, true FROM p),
a AS (SELECT * FROM ({_vector_sql('h', 'pair')}) JOIN p USING (pair))
SELECT a.pair, round(({_dot_sql(_OFF, 'a.')}) - ({_dot_sql(_OFF, 'b.')}), 6) AS delta_o, round(({_dot_sql(_DEF, 'b.')}) - ({_dot_sql(_DEF, 'a.')}), 6) AS delta_d,
{_part_sql(_OFF, ['weighted_off', 'weighted_def', 'top1_off', 'top2_off'])} AS talent_off, {_part_sql(_OFF, ['three_coverage', 'pg_creation'])} AS spacing, {_part_sql(_DEF, ['rim_protection'], '-')} AS rim, {_part_sql(_OFF, ['bench_off', 'usage_hhi'])} AS depth FROM a JOIN v b ON b.school = a.school""")
def m24(spark, d):
    got = T.counterfactual(_team_pairs(spark, d), _filled(spark, d).drop("tier"), _context(spark, d), _OFF, _DEF)
    return got.select("pair", *[r6(c) for c in ("delta_o", "delta_d", "talent_off", "spacing", "rim", "depth")])


@R("M25_bootstrap_ci")
def m25(spark, d):
    """Twenty replicates of every pair; a test compares the intervals with perturbations in NumPy."""
    got = T.bootstrap_interval(_team_pairs(spark, d), _filled(spark, d).drop("tier"), _context(spark, d), _OFF, _DEF, 2.0, n=20)
    return got.select("pair", r6("low"), r6("high"))


@R("C12_team_rating")
def c12(spark, d):
    """Roster vectors of all schools, ridge models of two ratings, the counterfactual of every pair with its interval and the percentile among all pairs' differences."""
    rows, context = stage(_filled(spark, d).drop("tier"), "rosters"), _context(spark, d)
    money = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("school")).agg((F.avg("l_extendedprice") / 1000).alias("adj_o"), (F.avg("l_tax") * 1000).alias("adj_d"))
    train = T.roster_vector(rows.join(context, "school"), "school").join(money, "school")
    train = stage(train, "ratings")
    off, deff = (M.ridge_fit(train, y, list(T.ROSTER_FEATURES), alpha=1.0) for y in ("adj_o", "adj_d"))
    pairs = _team_pairs(spark, d)
    got = T.counterfactual(pairs, rows, context, off, deff).join(pairs.select("pair", "minutes", "value"), "pair")
    low, high = T.analytic_interval(F.col("delta_em"), off["residual_std"], deff["residual_std"], F.lit(0), F.col("value"), F.lit(0.5), F.col("minutes"), F.lit(3.0))
    return got.select("pair", "school", *[r6(c) for c in ("base_o", "base_d", "delta_o", "delta_d", "delta_em", "talent_off", "talent_def")], r6(low, "low"), r6(high, "high"))


@R("J21_remap_owner", "SELECT o_orderkey, c_nationkey AS source, (c_nationkey + 1) % 25 AS nation, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 2000")
def j21(spark, d):
    """Customers with a low balance move on to the next nation; their orders go with them."""
    c = table(spark, d, "customer")
    owned = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    moves = c.where("c_acctbal < 2000").select(F.col("c_custkey").alias("o_custkey"), ((F.col("c_nationkey") + 1) % 25).alias("to"))
    return T.remap_owner(owned, moves, "o_custkey", "nation", "to").select("o_orderkey", "source", "nation", "o_totalprice")
