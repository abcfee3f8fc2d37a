"""Reliabilities, shares and weighted scores of a fit, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineup.functions.scalars import clip

# What each lack of reliability adds to an interval's width, and what is taken where the reliability is not known.
SPREAD = {"sample": (0.55, 0.0), "projection": (0.25, 0.5), "roster": (0.20, 0.5), "position": (0.18, 0.5), "match": (0.18, 1.0)}
SPREAD_BASE, SPREAD_A_FEATURE, SPREAD_FEATURES, SPREAD_MOST = 0.60, 0.025, 0.25, 2.10
# A flag is raised where its reliability is below the first number; the second is taken where it is not known.
FLAGS = {"sample": (0.45, 0.0), "position": (0.65, 1.0), "roster": (0.6, 0.0), "match": (0.75, 1.0)}
WIDE_PROJECTION = 7.5
# Minutes of a team, parts of displaced minutes, shares of minutes by role.
TEAM_MINUTES, SLOTS, NO_OPENING, SAME_POSITION = 200.0, 5, 0.35, 0.65
ROLE_SHARES, MOST_SHARE = (0.10, 0.45, 0.70, 0.875), 0.95


def _or(x: Column, value: float) -> Column:
    return F.coalesce(x.cast("double"), F.lit(float(value)))


def confidence_adjust(score: Column, confidence: Column) -> Column:
    """A score drawn towards 50 as confidence falls; an unknown score is 50, an unknown confidence 0."""
    return clip(50 + clip(_or(confidence, 0), 0.0, 1.0) * (_or(score, 50) - 50), 10.0, 90.0)


def weighted_overall(weights: dict[str, float]) -> Column:
    """The weighted sum of columns, held between 0 and 100; weights are not negative and sum to 1."""
    if not weights or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must not be negative and must sum to 1")
    return clip(reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in weights.items()]), 0.0, 100.0)


def normalize_weights(weights: dict[str, float], present: list[str], fixed: str | None = None, share: float = 0.2) -> dict[str, float]:
    """Weights of the columns that are there, none negative, summing to 1; ``fixed`` has a share of its own."""
    held = fixed if fixed in present and fixed in weights else None
    free = {c: max(float(w), 0.0) for c, w in weights.items() if c in present and c != held}
    total, room = sum(free.values()), 1.0 - (share if held else 0.0)
    if not free:
        return {held: 1.0} if held else {}
    out = {c: room * (w / total if total else 1 / len(free)) for c, w in free.items()}
    return out | ({held: share} if held else {})


def reliability(games: Column, minutes: Column, position: Column, missing: Column, features: int, all_games: float = 20.0, all_minutes: float = 55.0) -> Column:
    """Games, root of minutes, position and missing features, each between 0 and 1, multiplied."""
    sample = clip(_or(games, 0) / all_games, 0.0, 1.0) * F.sqrt(clip(_or(minutes, 0) / all_minutes, 0.0, 1.0))
    return sample * clip(_or(position, 0.5), 0.0, 1.0) * clip(1 - 0.5 * _or(missing, 0) / features, 0.5, 1.0)


def uncertainty_multiplier(known: dict[str, Column], missing: Column) -> Column:
    """What widens an interval, from the reliabilities in ``SPREAD`` (any may be absent) and a count of missing features."""
    parts = [w * (1 - clip(_or(known.get(k, F.lit(None)), value), 0.0, 1.0)) for k, (w, value) in SPREAD.items()]
    some = F.least(F.lit(SPREAD_FEATURES), _or(missing, 0) * SPREAD_A_FEATURE)
    return clip(reduce(lambda a, b: a + b, parts, F.lit(SPREAD_BASE)) + some, SPREAD_BASE, SPREAD_MOST)


def quality_flags(known: dict[str, Column], width: Column) -> Column:
    """A struct of flags for weak reliabilities and a wide projection."""
    low = [(_or(known.get(k, F.lit(None)), value) < limit).alias(f"low_{k}") for k, (limit, value) in FLAGS.items()]
    return F.struct(*low, (_or(width, 0) > WIDE_PROJECTION).alias("wide_projection"))


def split_displaced(expected: Column, open_minutes: Column, digits: int = 2) -> Column:
    """Whose minutes a newcomer takes: an open slot, the same position's depth, the flexible bench."""
    want, room = _or(expected, 0), clip(_or(open_minutes, 0), 0.0, TEAM_MINUTES)
    slot = F.least(want, F.when(room > 0, room / SLOTS).otherwise(want * NO_OPENING))
    rest = F.greatest(want - slot, F.lit(0.0))
    same = rest * SAME_POSITION
    return F.struct(F.round(slot, digits).alias("replacement_slot"), F.round(same, digits).alias("same_position_depth"), F.round(rest - same, digits).alias("flexible_bench"))


def survival_share(rotation: Column, starter: Column, heavy: Column) -> Column:
    """The expected share of minutes from three probabilities, each at most the one before."""
    chain = [F.lit(1.0)]
    for p in (rotation, starter, heavy):
        chain.append(F.least(clip(p, 0.0, 1.0), chain[-1]))
    chain.append(F.lit(0.0))
    return clip(reduce(lambda a, b: a + b, [s * (chain[k] - chain[k + 1]) for k, s in enumerate(ROLE_SHARES)]), 0.0, MOST_SHARE)


def returning_share(returning: Column, departing: Column, open_minutes: Column) -> Column:
    """Returning / (returning + the larger of departing and open), from maps by position; NULL if all are zero."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    back = total(returning)
    return back / F.nullif(back + F.greatest(total(departing), total(open_minutes)), F.lit(0.0))


def predict_batch(models: dict[str, tuple[float, dict[str, float]]]) -> dict[str, Column]:
    """A column for each saved linear model (intercept, coefficients); an unknown feature counts as zero."""
    return {name: reduce(lambda a, b: a + b, [_or(F.col(c), 0) * float(w) for c, w in coefficients.items()], F.lit(float(start))) for name, (start, coefficients) in models.items()}
