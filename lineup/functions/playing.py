"""Positions, roles, usage, style interactions and uncertainty of a candidate on a team, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineup.functions.fit import _or, clip

POSITIONS = ("PG", "SG", "SF", "PF", "C")
# Position weights by role, by height (up to so many inches), and how far each source is trusted.
ROLE_WEIGHTS = {
    "pure pg": (0.90, 0.10, 0.00, 0.00, 0.00),
    "scoring pg": (0.90, 0.10, 0.00, 0.00, 0.00),
    "combo g": (0.15, 0.75, 0.10, 0.00, 0.00),
    "wing g": (0.00, 0.65, 0.30, 0.05, 0.00),
    "wing f": (0.00, 0.05, 0.75, 0.15, 0.05),
    "stretch 4": (0.00, 0.00, 0.15, 0.80, 0.05),
    "pf/c": (0.00, 0.00, 0.05, 0.45, 0.50),
    "c": (0.00, 0.00, 0.00, 0.05, 0.95),
}
HEIGHT_WEIGHTS = ((73, (0.70, 0.25, 0.05, 0.00, 0.00)), (76, (0.20, 0.55, 0.20, 0.05, 0.00)), (79, (0.05, 0.20, 0.50, 0.20, 0.05)), (82, (0.00, 0.05, 0.25, 0.50, 0.20)), (None, (0.00, 0.00, 0.05, 0.25, 0.70)))
SOURCE_RELIABILITY = {"model": 1.00, "role": 0.82, "position": 0.72, "height": 0.55, "uniform": 0.40}
# Usage roles in order of preference on ties, and the limits of the role rules.
USAGE_ROLES = ("primary_creator", "secondary_creator", "connector", "play_finisher", "spacing_specialist", "rim_runner_rebounder", "defensive_specialist", "depth")
# Weights of the role fit's parts.
ROLE_FIT = {"minutes": 0.48, "path": 0.22, "usage": 0.18, "opportunity": 0.12}
# Most that each skill and style interaction adds; their sum is held within the cap.
STYLE_WEIGHTS = {"shooting": 0.12, "passing": 0.10, "creation": -0.10, "block": 0.09, "off_reb": 0.08, "def_reb": 0.07}
STYLE_CAP = 0.50
# The normal quantile of an 80 % interval, and which multiplier a box score's prefix takes.
Z80 = 1.2816
BOX_FACTORS = (("pts", "usage"), ("ast", "assist"), ("tov", "turnover"), ("to_", "turnover"), ("reb", "rebound"), ("oreb", "rebound"), ("dreb", "rebound"), ("blk", "block"))


def _weights(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def soft_positions(model: Column, role: Column, position: Column, height: Column) -> Column:
    """Struct (weights, source, reliability). The first source that says anything: a model's weights, the role's prior, the exact
    position, the height's prior, else all alike; weights sum to 1."""
    given = F.transform(F.coalesce(model, F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    name = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    by_role = F.create_map(*[x for k, v in ROLE_WEIGHTS.items() for x in (F.lit(k), _weights(v))])[name]
    exact = F.when(position.isin(*POSITIONS), F.transform(_weights(range(5)), lambda k: (F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (k + 1).cast("int")) == position).cast("double")))
    tall = F.when(height.isNull(), F.lit(None).cast("array<double>"))
    for most, v in HEIGHT_WEIGHTS:
        tall = tall.otherwise(_weights(v)) if most is None else tall.when(height <= most, _weights(v))
    known = [("model", F.when(_sum(given) >= 1e-6, given)), ("role", by_role), ("position", exact), ("height", tall), ("uniform", _weights([0.2] * 5))]
    structs = [F.when(w.isNotNull(), F.struct(w.alias("weights"), F.lit(s).alias("source"), F.lit(SOURCE_RELIABILITY[s]).alias("reliability"))) for s, w in known]
    found = F.coalesce(*structs)
    return F.struct(F.transform(found["weights"], lambda x: x / F.greatest(_sum(found["weights"]), F.lit(1e-9))).alias("weights"), found["source"].alias("source"), found["reliability"].alias("reliability"))


def depth_score(depth: Column) -> Column:
    """100 for an empty position, 20 less for each player there."""
    return clip(100 - 20 * depth, 0.0, 100.0)


def usage_budget(usage: Column, open_usage: Column, roster_reliability: Column, rotation: Column, share: Column, pull: float = 0.6) -> Column:
    """The part of a usage beyond the open usage is drawn in, less so the surer the player's minutes are; without a reliable roster it stays."""
    sure = clip(clip(_or(rotation, 0.5), 0.0, 1.0) * clip(_or(share, 0.5), 0.0, 1.0), 0.0, 1.0)
    beyond = F.greatest(usage - _or(open_usage, 0), F.lit(0.0))
    cut = F.when(open_usage.isNotNull() & (_or(roster_reliability, 0) >= 0.6), beyond * pull * (1 - 0.5 * sure)).otherwise(0.0)
    return F.greatest(usage - cut, F.lit(0.0))


def usage_role(usage: Column, minutes: Column, archetype: Column, skills: Column, sample: Column) -> Column:
    """Struct (role, confidence): rules score eight roles, the highest wins, the first of ``USAGE_ROLES`` on ties."""
    u, m, label = _or(usage, 0), _or(minutes, 0), F.lower(F.coalesce(archetype, F.lit("")))
    skill = lambda k: _or(skills[F.lit(k)], 0)
    says = lambda *words: reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in words])
    creator = says("playmaker", "creator") | (skill("passing_creation") >= 65)
    rules = [
        ("primary_creator", (u >= 25) & (m >= 24), 3.0),
        ("secondary_creator", u >= 20, 2.0),
        ("connector", u.between(14, 22), 1.5),
        ("play_finisher", u.between(14, 22), 1.0),
        ("depth", (u < 15) | (m < 10), 2.0),
        ("spacing_specialist", says("shoot", "spacing") | (skill("shooting_3p") >= 65), 2.5),
        ("primary_creator", creator, 1.5),
        ("secondary_creator", creator, 1.5),
        ("rim_runner_rebounder", says("big", "rim", "rebound"), 2.5),
        ("defensive_specialist", says("def") | (skill("steal_disruption") >= 70) | (skill("block_rim_protection") >= 70), 2.0),
        ("depth", m >= 18, -1.5),
    ]
    total = lambda r: reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for n, c, v in rules if n == r])
    ranked = F.array_sort(F.array(*[F.struct((-total(r)).alias("minus"), F.lit(k).alias("k")) for k, r in enumerate(USAGE_ROLES)]))
    margin = F.greatest(ranked[1]["minus"] - ranked[0]["minus"], F.lit(0.0))
    names = F.array(*[F.lit(r) for r in USAGE_ROLES])
    return F.struct(F.element_at(names, ranked[0]["k"] + 1).alias("role"), clip(0.45 + 0.12 * margin + 0.20 * _or(sample, 0), 0.25, 0.95).alias("confidence"))


def role_fit_score(minutes: Column, usage: Column, ci_width: Column, players: Column, open_minutes: Column, rotation: Column, starter: Column, digits: int = 2) -> Column:
    """Minutes, path to a role, usage near 20 and opening, each 0-100, less what an unsure forecast and a crowded roster cost."""
    m = _or(minutes, 0)
    parts = {
        "minutes": clip(m / 28 * 100, 0.0, 100.0),
        "path": clip(65 * clip(F.coalesce(rotation, m / 28), 0.0, 1.0) + 35 * clip(F.coalesce(starter, m / 32), 0.0, 1.0), 0.0, 100.0),
        "usage": clip(100 - F.abs(_or(usage, 0) - 20) * 2, 40.0, 100.0),
        "opportunity": clip(clip(_or(open_minutes, 0), 0.0, 200.0) / 80 * 100, 35.0, 100.0),
    }
    cost = clip(_or(ci_width, 0) / 16 * 18, 0.0, 25.0) + clip(F.greatest(_or(players, 12) - 12, F.lit(0.0)) * 1.25, 0.0, 15.0)
    return F.round(clip(reduce(lambda a, b: a + b, [w * parts[k] for k, w in ROLE_FIT.items()]) - cost, 0.0, 100.0), digits)


def _above(p: Column) -> Column:
    """A percentile from -1 to 1; unknown is neutral."""
    return (_or(p, 50) - 50) / 50


def _open_usage(usage: Column) -> Column:
    return clip((0.25 - clip(_or(usage, 0.20), 0.0, 0.35)) / 0.25, 0.0, 1.0)


def style_interactions(skills: dict[str, Column], team: dict[str, Column], usage: Column, weights: dict[str, float] | None = None) -> Column:
    """Six products of a skill (percentile) and a team's style or need, weighted; the sum is held within the cap.

    ``skills``: shooting, passing, creation, block, off_reb, def_reb; ``team``: threes, crowding, rim_need, rim_share, frontcourt_need. Any may be absent.
    """
    w = STYLE_WEIGHTS | (weights or {})
    own = lambda k: _above(skills.get(k, F.lit(None)))
    need = lambda k, d=0.0: _or(team.get(k, F.lit(None)), d)
    context = {
        "shooting": need("threes", 0.35),
        "passing": _open_usage(usage),
        "creation": clip(need("crowding"), 0.0, 1.0),
        "block": clip(need("rim_need"), 0.0, 1.0),
        "off_reb": clip(need("rim_share", 0.30) - 0.30, 0.0, 0.4) / 0.4,
        "def_reb": clip(need("frontcourt_need"), 0.0, 1.0),
    }
    return clip(reduce(lambda a, b: a + b, [own(k) * c * w[k] for k, c in context.items()]), -STYLE_CAP, STYLE_CAP)


def propagate_uncertainty(value: Column, low: Column, high: Column, minutes: Column, minutes_width: Column, residual_std: float, flagged: Column, role_confidence: Column, tier_jump: Column, games: Column, scale: float = 1.0) -> Column:
    """P50: struct (low, high, multiplier): root of the summed variances of value, minutes and model, times what widens the interval."""
    own = ((F.coalesce(high, value) - F.coalesce(low, value)) / 2) ** 2
    playing = 0.25 * (_or(minutes_width, 0) / F.greatest(_or(minutes, 1), F.lit(1.0))) ** 2
    wide = (
        F.when(F.coalesce(flagged, F.lit(False)), 1.5).otherwise(1.0)
        * clip(1 + 0.25 * (1 - clip(_or(role_confidence, 0.75), 0.0, 1.0)), 1.0, 1.25)
        * clip(1 + 0.15 * clip(F.abs(_or(tier_jump, 0)), 0.0, 3.0), 1.0, 1.45)
        * F.when(_or(games, 30) < 15, 1.15).otherwise(1.0)
        * float(scale)
    )
    half = Z80 * F.greatest(F.sqrt(own + playing + residual_std**2) * wide, F.lit(0.1))
    return F.struct((value - half).alias("low"), (value + half).alias("high"), wide.alias("multiplier"))


def box_factors(usage: Column, source_usage: Column, passing: Column, big: Column, frontcourt_need: Column, rim_need: Column) -> Column:
    """Struct (usage, assist, turnover, rebound, block): multipliers of a box score on another team."""
    own = clip(_or(usage, 0.20), 0.05, 0.50)
    f = clip(own / clip(_or(source_usage, 0.20), 0.05, 0.50), 0.80, 1.20)
    context = clip(_above(passing) * _open_usage(own) * 0.10, -0.08, 0.08)
    tall = lambda need: F.when(F.coalesce(big, F.lit(False)), 1 + 0.08 * clip(_or(need, 0), 0.0, 1.0)).otherwise(1.0)
    return F.struct(f.alias("usage"), clip(1 + 0.5 * (f - 1) + context, 0.85, 1.15).alias("assist"), clip(1 + 0.75 * (f - 1), 0.85, 1.20).alias("turnover"), tall(frontcourt_need).alias("rebound"), tall(rim_need).alias("block"))


def rescale_rates(rates: Column, factors: Column, minutes: Column, digits: int | None = 2) -> Column:
    """A map of rates per 40 minutes as rates per game, each with the multiplier of its prefix; without ``digits`` as they are."""
    played = F.greatest(_or(minutes, 0), F.lit(0.0))

    def factor(key: Column) -> Column:
        out = F.lit(1.0)
        for prefix, name in reversed(BOX_FACTORS):
            out = F.when(F.startswith(F.lower(key), F.lit(prefix)), factors[name]).otherwise(out)
        return out

    per_game = lambda k, v: _or(v, 0) * factor(k) * played / 40
    scaled = F.transform_values(F.coalesce(rates, F.create_map().cast("map<string,double>")), per_game if digits is None else lambda k, v: F.round(per_game(k, v), digits))
    return F.transform_keys(scaled, lambda k, v: F.replace(k, F.lit("_per_40"), F.lit("_per_game")))


def what_if_role_fit(stored: Column, before: Column, after: Column) -> Column:
    """A stored role fit moved by the difference that other minutes or usage make to the score."""
    return clip(F.coalesce(stored, before) + (after - before), 0.0, 100.0)


def kalman_uncertainty(posterior: Column, process: Column, observation: Column, digits: int = 6) -> Column:
    """Struct: deviation, share of the noise that is movement, confidence and its label; NULL for negative or non-finite variances."""
    ok = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")) for x in (posterior, process, observation)])
    confidence = F.when(posterior + observation > 0, observation / (posterior + observation)).otherwise(0.0)
    movement = F.when(process + observation > 0, process / (process + observation)).otherwise(0.0)
    label = F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")
    r = lambda x, n: F.round(x, digits).alias(n)
    return F.when(ok, F.struct(r(F.sqrt(posterior), "std"), r(movement, "process_share"), r(1 - movement, "observation_share"), r(confidence, "confidence"), label.alias("label")))


def design_matrix(df, features: list[str], categories: dict[str, list[str]], medians: dict[str, float] | None = None) -> list[Column]:
    """Columns of a design matrix: features (missing ones are their median, else 0) and one column per listed category value."""
    out = [_or(F.col(c), (medians or {}).get(c, 0.0)).alias(c) if c in df.columns else F.lit(float((medians or {}).get(c, 0.0))).alias(c) for c in features]
    for c, values in categories.items():
        own = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out += [F.coalesce((own == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in values]
    return out


def opportunity_features(a: dict[str, Column]) -> dict[str, Column]:
    """Derived ratios, shares and deltas of a player and an open roster, from the columns that are given by name; a missing one counts as 0."""
    g = lambda k, d=0.0: _or(a.get(k, F.lit(None)), d)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    open_pos, open_all, dep_pos, ret_pos = g("open_minutes_position"), g("open_minutes"), g("departing_minutes_position"), g("returning_minutes_position")
    share = clip(g("prior_min_pct") / 100, 0.0, 1.0)
    out = {
        "prior_minutes_share": share,
        "prior_minutes_game": share * 40,
        "open_share_position": ratio(open_pos, open_all),
        "position_competition": ratio(ret_pos, ret_pos + open_pos),
        "departed_share_position": ratio(dep_pos, dep_pos + ret_pos),
        "open_to_prior_minutes": ratio(open_pos, share * 40),
        "usage_gap": g("prior_usage", 20) - g("open_usage_position"),
        "usage_pressure": ratio(g("prior_usage", 20), g("open_usage_position")),
        "level_jump": g("target_rating") - g("source_rating"),
        "value_over_roster": g("value_per_100") - g("roster_value"),
        "games_share": clip(g("prior_games") / 30, 0.0, 1.0),
        "reliability": clip(g("sample_reliability"), 0.0, 1.0) * clip(g("roster_reliability"), 0.0, 1.0),
        "minutes_at_stake": share * 40 * clip(g("position_confidence"), 0.0, 1.0),
        "is_newcomer": F.when(F.coalesce(a.get("prior_games", F.lit(None)), F.lit(0)) > 0, 0.0).otherwise(1.0),
    }
    return out | {"missing_count": reduce(lambda x, y: x + y, [c.isNull().cast("int") for c in a.values()])}
