"""What a player is worth at another team: a neutral value moved by role, style, roster and tier, with an interval and rescaled rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.functions.playing import box_factors, propagate_uncertainty, rescale_rates, style_interactions
from lineup.functions.scalars import clip_deltas, piecewise_linear
from lineup.operators.extras import tier_matrix
from lineup.operators.models import predict, ridge_fit
from lineup.operators.tables import payload

# Most that each part and their sum may move a value; what a returning share of a roster (per cent) costs or gives.
PART_CAPS, TOTAL_CAP = [0.75, 0.50, 0.50, 0.75], 1.50
ROSTER_POINTS = [(0.0, 0.50), (25.0, 0.20), (50.0, 0.0), (75.0, -0.25), (100.0, -0.50)]
PARTS = ("role", "style", "roster", "tier")


def fit_moves(train: DataFrame, target: str, features: list[str], change: str, alpha: float = 0.0) -> tuple[dict, DataFrame]:
    """M06 and A24 on moves that are over: the ridge model of ``target`` and the 16 effects of ``source_tier`` and ``target_tier`` on ``change``."""
    return ridge_fit(train.dropna(subset=[target, *features]), target, features, alpha), tier_matrix(train, "source_tier", "target_tier", change)


def project_destinations(pairs: DataFrame, role: dict, tiers: DataFrame, skills: dict[str, Column], team: dict[str, Column], role_weight: float) -> DataFrame:
    """``value, low, high, parts`` (array in the order of ``PARTS``), ``factor`` (how far the sum was held back), ``rates`` per game, ``explanation``.

    ``pairs``: ``neutral, neutral_low, neutral_high, usage, source_usage, returning_share, source_tier, target_tier, minutes, minutes_width, games,
    rates`` (a map per 40 minutes) and the features of the role model. ``tiers`` has 16 rows, so it is broadcast. A pair without a neutral value has
    no value; a missing role feature or returning share moves nothing.
    """
    p = pairs.join(F.broadcast(tiers.select("source_tier", "target_tier", F.col("effect").alias("_tier"))), ["source_tier", "target_tier"], "left")
    none = F.lit(0.0)
    moves = [
        F.coalesce(predict(role) * role_weight, none),
        style_interactions(skills, team, F.col("usage") / 100),
        F.coalesce(piecewise_linear(F.col("returning_share"), ROSTER_POINTS), none),
        F.coalesce("_tier", none),
    ]
    p = p.withColumn("_raw", F.array(*moves))
    held = clip_deltas([F.get("_raw", F.lit(i)) for i in range(len(PARTS))], PART_CAPS, TOTAL_CAP)
    p = p.withColumn("parts", F.array(*held)).withColumn("value", F.col("neutral") + F.aggregate("parts", none, lambda a, x: a + x))
    jump = (F.col("source_tier") - F.col("target_tier")).cast("double")
    spread = propagate_uncertainty(F.col("value"), F.col("value") - (F.col("neutral") - F.col("neutral_low")), F.col("value") + (F.col("neutral_high") - F.col("neutral")), F.col("minutes"), F.col("minutes_width"), role["residual_std"] * role_weight, F.col("neutral_low").isNull(), F.lit(None).cast("double"), jump, F.col("games"))
    p = p.withColumn("_ci", spread).withColumns({"low": F.col("_ci.low"), "high": F.col("_ci.high"), "multiplier": F.col("_ci.multiplier")})
    factors = box_factors(F.col("usage") / 100, F.col("source_usage") / 100, skills.get("passing", F.lit(None)), F.lit(False), F.lit(0.0), F.lit(0.0))
    p = p.withColumn("rates", rescale_rates(F.col("rates"), factors, F.col("minutes"), None))
    said = payload(source_tier=F.col("source_tier"), target_tier=F.col("target_tier"), largest=F.element_at(F.array(*[F.lit(x) for x in PARTS]), F.array_position(F.transform("parts", lambda x: F.abs(x)), F.array_max(F.transform("parts", lambda x: F.abs(x)))).cast("int")))
    return p.withColumn("explanation", said).drop("_raw", "_ci", "_tier")
