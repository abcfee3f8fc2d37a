"""What a player brings and what a roster leaves open, as column expressions over one row per player, team and season."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineup.functions.fit import TEAM_MINUTES, _or
from lineup.functions.playing import POSITIONS
from lineup.functions.scalars import clip

# Positions of each group, minutes of a game, and the share of open minutes that one player may take.
POSITION_GROUPS = {"guard": ("PG", "SG", "G"), "wing": ("SF", "F"), "forward": ("PF",), "big": ("C",)}
GAME_MINUTES, OPEN_PART = 40.0, 0.4
# Games and minutes (per cent) of a full sample, the width of a projection that halves its reliability and its least value,
# reliabilities with and without a roster, what is taken for an unknown position, archetype or matched transfer.
FULL_GAMES, FULL_MINUTES, HALF_WIDTH, LEAST_PROJECTION = 20.0, 55.0, 8.0, 0.2
ROSTER_KNOWN, ROSTER_UNKNOWN, NO_POSITION, NO_ARCHETYPE, NO_MATCH = 0.9, 0.45, 0.5, 0.45, 0.5
# Most career seasons, shares of a position's minutes, crowding and opening.
MOST_SEASONS, MOST_SHARES, MOST_CROWDING, MOST_OPENING = 8.0, 5.0, 10.0, 20.0

#: Columns that are read, all doubles but the position and the maps by position; one that the caller has not is NULL.
PLAYER = ("season", "prior_min_pct", "prior_usage_rate", "prior_games_played", "prior_points_per_game", "prior_rebounds_per_game", "prior_assists_per_game", "prior_college_seasons", "first_observed_season", "height_inches", "value_per_100", "value_ci_lower", "value_ci_upper", "archetype_confidence", "is_transfer", "candidate_changes_school", "is_portal_candidate", "transfer_match_confidence", "same_school_baseline")
TEAM = ("team_adj_em", "team_adj_o", "team_adj_d", "team_adj_tempo", "roster_player_count", "prior_team_usage_total", "prior_team_minutes", "prior_team_rotation_hhi", "prior_team_rotation_players", "same_position_usage_total", "same_position_usage_max", "same_position_prior_minutes", "same_position_prior_max_minutes", "same_position_prior_count", "returning_production", "returning_player_impact")
#: Maps by position, what is made of each for the pair's position, and the most that it may say.
MAPS = {
    "returning_minutes_by_position": ("returning_minutes_position", TEAM_MINUTES),
    "departing_minutes_by_position": ("departing_minutes_position", TEAM_MINUTES),
    "incoming_transfer_minutes_by_position": ("incoming_transfer_minutes_position", TEAM_MINUTES),
    "open_minutes_by_position": ("roster_open_minutes", TEAM_MINUTES),
    "open_usage_by_position": ("open_usage_position", 100.0),
}
CONFIDENCES = tuple(f"pos_confidence_{p.lower()}" for p in POSITIONS)
#: The first feature that needs more than the player's own columns.
FIRST_OF_TEAM = "roster_open_minutes"
#: Columns that go into a model as they came.
_PLAIN = ("value_per_100", "prior_usage_rate", "prior_games_played", "prior_points_per_game", "prior_rebounds_per_game", "prior_assists_per_game", "height_inches", *TEAM)


def position_group(position: Column) -> Column:
    """The group of a position, else ``unknown``."""
    p = F.upper(F.coalesce(position, F.lit("")))
    return reduce(lambda held, g: held.when(p.isin(*POSITION_GROUPS[g]), g), list(POSITION_GROUPS)[1:], F.when(p.isin(*POSITION_GROUPS["guard"]), "guard")).otherwise("unknown")


def _number(x: Column) -> Column:
    """A double; NaN is NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def mean_entry(values: Column) -> Column:
    """The mean of a map's entries that are neither NULL nor NaN, added from the smallest on; NULL without any."""
    return _mean(F.map_values(values))


def _mean(values: Column) -> Column:
    every = F.sort_array(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(every), F.lit(0))


def position_keys(position: Column) -> Column:
    """The names under which a map may hold a position, in the order of their preference."""
    p = F.upper(F.coalesce(position.cast("string"), F.lit("")))
    return F.array(p, F.lower(p), position_group(p), F.lit("total"), F.lit("all"))


def entry_of(values: Column, keys: Column, mean: Column, most: float) -> Column:
    """The first entry of a map under one of ``keys`` that is neither NULL nor NaN, else ``mean``, between 0 and ``most``."""
    own = F.filter(F.transform(keys, lambda k: F.try_element_at(values, k)), lambda v: v.isNotNull() & ~F.isnan(v))
    return clip(F.coalesce(F.get(own, F.lit(0)), mean), 0.0, most)


def by_position(values: Column, position: Column, most: float = TEAM_MINUTES) -> Column:
    """A map's entry for a position: its own, else its group's, else ``total`` or ``all``, else the mean of all entries, between 0 and ``most``.
    Entries that are NULL or NaN say nothing; NULL without any entry."""
    return entry_of(values, position_keys(position), mean_entry(values), most)


def _over(x: Column, n: Column) -> Column:
    """A mean per one of ``n``; nothing known is 0."""
    return F.coalesce(_or(x, 0) / F.nullif(n, F.lit(0.0)), F.lit(0.0))


def of_position(columns: list[str]) -> dict[str, Column]:
    """The entries of the maps in ``columns`` for the row's position. Several features read each, so they are columns before the features are."""
    have = set(columns)
    position = F.col("position") if "position" in have else F.lit(None)
    return {out: by_position(F.col(c), position, most) for c, (out, most) in MAPS.items() if c in have}


def entry_means(entries: Column) -> dict[str, Column]:
    """Means of a map's entries (structs with a field for each of ``MAPS``), which are the same for all rows of a team: made once a team they need not be made once a player."""
    return {f"_mean_{c}": _mean(F.transform(F.map_values(entries), lambda x: x[c])) for c in MAPS}


def entries_of_position(hits: Column) -> dict[str, Column]:
    """``of_position`` of one map with structs of all of ``MAPS``, from its entries under the names of the row's position and ``entry_means``."""
    own = lambda c: F.get(F.filter(F.transform(hits, lambda x: x[c]), lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(0))
    return {out: clip(F.coalesce(own(c), F.col(f"_mean_{c}")), 0.0, most) for c, (out, most) in MAPS.items()}


def numbers(columns: list[str]) -> dict[str, Column]:
    """Those of ``columns`` that features are made of, as doubles; NaN is NULL."""
    return {c: _number(F.col(c)) for c in columns if c in (*PLAYER, *TEAM, *CONFIDENCES)}


def missing_count(names: list[str]) -> Column:
    """How many of these columns are NULL."""
    return F.size(F.filter(F.array(*names), lambda x: x.isNull()))


def opportunity_features(columns: list[str], clean: bool = False) -> dict[str, Column]:
    """All features of a pair by name, from those of ``PLAYER``, ``TEAM``, ``CONFIDENCES``, ``position`` and ``of_position`` that ``columns`` has.

    Nulls: a player without an earlier season has 0 minutes and the first career index; maps without an entry leave the position's minutes NULL,
    which count as 0 in sums and ratios; ``missing_feature_count`` is the number of model features that are NULL. ``clean``: ``numbers`` are made.
    """
    have = set(columns)
    number = lambda c: (F.col(c) if clean else _number(F.col(c))) if c in have else F.lit(None).cast("double")
    g = {c: number(c) for c in (*PLAYER, *TEAM, *CONFIDENCES, *[out for out, _ in MAPS.values()])}
    position = F.col("position").cast("string") if "position" in have else F.lit(None).cast("string")
    flag = lambda c: c.cast("double")
    one = lambda c: clip(c, 0.0, 1.0)

    share = F.greatest(_or(g["prior_min_pct"], 0), F.lit(0.0)) / 100
    minutes = share * GAME_MINUTES
    width = F.when(g["value_ci_upper"].isNotNull() & g["value_ci_lower"].isNotNull(), F.greatest(g["value_ci_upper"] - g["value_ci_lower"], F.lit(0.0)))
    past = _or(g["prior_college_seasons"], 0)
    returning, departing, incoming = (g[f"{k}_minutes_position"] for k in ("returning", "departing", "incoming_transfer"))
    opened = _or(g["roster_open_minutes"], 0)
    back, gone, new = _or(returning, 0), _or(departing, 0), _or(incoming, 0)
    moved = _or(g["is_transfer"], 0)
    named = {p: flag(F.upper(F.coalesce(position, F.lit(""))) == p) for p in POSITIONS}

    player = {
        "prior_minutes": minutes,
        "prior_minutes_share": share,
        "projection_ci_width": width,
        "prior_college_seasons": past,
        "is_no_prior_college_season": flag(past <= 0),
        "career_season_index": clip(past + 1, 1.0, MOST_SEASONS),
        "years_since_first_observed": F.coalesce(clip(g["season"] - g["first_observed_season"], 0.0, MOST_SEASONS), F.lit(0.0)),
        **{f"position_is_{p.lower()}": x for p, x in named.items()},
        **{f"position_group_{k}": flag(position_group(position) == k) for k in POSITION_GROUPS},
        "position_confidence": F.coalesce(one(F.greatest(*[g[c] for c in CONFIDENCES])), F.lit(NO_POSITION)),
        "archetype_confidence": _or(g["archetype_confidence"], NO_ARCHETYPE),
        "is_transfer": moved,
        "candidate_changes_school": F.coalesce(g["candidate_changes_school"], moved),
        "is_portal_candidate": _or(g["is_portal_candidate"], 0),
        "transfer_match_confidence": F.coalesce(g["transfer_match_confidence"], F.when(moved.cast("int") == 1, NO_MATCH).otherwise(1.0)),
        "same_school_baseline": _or(g["same_school_baseline"], 0),
    }
    roster = {
        "roster_open_minutes": opened,
        "returning_minutes_position": returning,
        "departing_minutes_position": departing,
        "incoming_transfer_minutes_position": incoming,
        "open_usage_position": g["open_usage_position"],
        "position_opportunity_delta": gone + new - back,
        "returning_minutes_share_position": clip(back / 100, 0.0, MOST_SHARES),
        "open_minutes_share_position": clip(opened / 100, 0.0, MOST_SHARES),
        "same_position_minutes_mean": _over(g["same_position_prior_minutes"], g["same_position_prior_count"]),
        "same_position_usage_mean": _over(g["same_position_usage_total"], g["same_position_prior_count"]),
        "prior_team_minutes_mean": _over(g["prior_team_minutes"], g["prior_team_rotation_players"]),
        "returning_production_per_rotation_player": _over(g["returning_production"], g["prior_team_rotation_players"]),
    }
    ratios = {
        "position_crowding_ratio": clip(back / F.greatest(opened, F.lit(1.0)), 0.0, MOST_CROWDING),
        "opportunity_to_prior_minutes_ratio": clip(opened * OPEN_PART / F.greatest(minutes, F.lit(1.0)), 0.0, MOST_OPENING),
        "open_minutes_minus_returning_position": opened - back,
        "departing_minus_incoming_transfer_minutes": gone - new,
        "sample_reliability": one(_or(g["prior_games_played"], 0) / FULL_GAMES) * F.sqrt(one(_or(g["prior_min_pct"], 0) / FULL_MINUTES)),
        "projection_reliability": clip(1 / (1 + _or(width, HALF_WIDTH) / HALF_WIDTH), LEAST_PROJECTION, 1.0),
        "roster_reliability": F.when(g["roster_player_count"].isNotNull(), ROSTER_KNOWN).otherwise(ROSTER_UNKNOWN),
    }
    out = player | roster | ratios | {c: g[c] for c in _PLAIN}
    return out | {"missing_feature_count": reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in out.values()])}
