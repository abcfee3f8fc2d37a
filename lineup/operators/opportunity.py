"""Context of a player's season for P61: the team's and the position's earlier season, who returns, leaves and comes, and the joined frame.

``stats`` has one row per player and season with ``player, season, school, position, min_pct, usage_rate``; contexts are aggregates by team,
so they have a row per team and season (and position) and are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.opportunity import FIRST_OF_TEAM, GAME_MINUTES, entries_of_position, entry_means, missing_count, numbers, opportunity_features, position_keys
from lineup.functions.scalars import clip
from lineup.operators.extras import mask_leaky
from lineup.operators.joins import enrich

#: A player with this share of the minutes (per cent) belongs to the rotation. Fixed value.
ROTATION = 50.0
#: Minutes that a position of a team offers. Fixed value.
POSITION_MINUTES = 40.0
#: Columns of a projection that tell a season's own result unless the projection is a forecast.
LEAKY = ("value_per_100", "value_ci_lower", "value_ci_upper")
#: The maps by position of a roster's flow, and the column that each is made of.
FLOWS = {
    "returning_minutes_by_position": "returning",
    "departing_minutes_by_position": "departing",
    "incoming_transfer_minutes_by_position": "incoming",
    "open_minutes_by_position": "open",
    "open_usage_by_position": "open_usage",
}


def _played() -> Column:
    return F.col("min_pct") / 100 * GAME_MINUTES


def team_context(stats: DataFrame) -> DataFrame:
    """Minutes, their concentration, rotation players and usage of a team, told of the season after: ``school, season, prior_team_...``."""
    rows = stats.where(F.col("min_pct").isNotNull()).withColumn("_m", _played())
    sums = rows.groupBy("school", (F.col("season") + 1).alias("season")).agg(
        F.sum("_m").alias("prior_team_minutes"),
        F.sum(F.col("_m") * F.col("_m")).alias("_sq"),
        F.count_if(F.col("min_pct") >= ROTATION).cast("double").alias("prior_team_rotation_players"),
        F.sum("usage_rate").alias("prior_team_usage_total"),
    )
    total = F.col("prior_team_minutes")
    return sums.withColumn("prior_team_rotation_hhi", F.when(total > 0, F.col("_sq") / (total * total))).drop("_sq")


def position_context(stats: DataFrame) -> DataFrame:
    """Minutes and usage of a team's players of one position, told of the season after: ``school, season, position, same_position_...``."""
    rows = stats.where(F.col("min_pct").isNotNull() & F.col("position").isNotNull()).withColumn("_m", _played())
    return rows.groupBy("school", (F.col("season") + 1).alias("season"), "position").agg(
        F.sum("_m").alias("same_position_prior_minutes"),
        F.max("_m").alias("same_position_prior_max_minutes"),
        F.count("*").cast("double").alias("same_position_prior_count"),
        F.sum("usage_rate").alias("same_position_usage_total"),
        F.max("usage_rate").alias("same_position_usage_max"),
    )


def _flow(stats: DataFrame) -> DataFrame:
    """Of each team, season and position: earlier minutes of those that return, leave and come from elsewhere, and what is open.

    Each season is looked at twice, as itself and as the one before, so one full join by player and season finds every move.
    """
    now = stats.select("player", "season", "school", "position")
    before = stats.select("player", (F.col("season") + 1).alias("season"), F.col("school").alias("_from"), F.col("position").alias("_at"), _played().alias("_m"), F.col("usage_rate").alias("_u"))
    both = now.join(before, ["player", "season"], "full")
    stays = F.col("school") == F.col("_from")
    side = lambda school, position, kind, used: F.struct(school.alias("school"), position.alias("position"), kind.alias("kind"), used.alias("used"))
    here = F.when(F.col("school").isNotNull(), side(F.col("school"), F.col("position"), F.when(stays, "returning").when(F.col("_from").isNotNull(), "incoming").otherwise("new"), F.coalesce("_m", F.lit(0.0))))
    left = F.when(F.col("_from").isNotNull() & ~F.coalesce(stays, F.lit(False)), side(F.col("_from"), F.col("_at"), F.lit("departing"), F.col("_m")))
    rows = both.select("season", F.col("_u"), F.explode(F.array_compact(F.array(here, left))).alias("s")).select("season", "_u", "s.*")

    total = lambda kind, what="used": F.sum(F.when(F.col("kind") == kind, F.col(what)))
    per = rows.groupBy("school", "season", "position").agg(
        *[total(k).alias(k) for k in ("returning", "departing", "incoming")],
        clip(total("departing", "_u"), 0.0, 100.0).alias("open_usage"),
        F.sum(F.when(F.col("kind") == "returning", F.col("used") * F.col("_u") / 100)).alias("production"),
        F.max(F.when(F.col("kind") == "returning", F.col("used") * F.col("_u") / 100)).alias("impact"),
        F.count_if(F.col("kind") != "departing").alias("players"),
    )
    return per.withColumn("open", F.greatest(POSITION_MINUTES - F.coalesce("returning", F.lit(0.0)), F.lit(0.0)))


def roster_flow(stats: DataFrame) -> DataFrame:
    """Of each team and season: earlier minutes of those that return, leave and come from elsewhere, minutes and usage that are open, each a map by
    position; returning production and impact; number of players.

    A player without a position counts in no map. Maps have an entry per position, of which there are a handful.
    """
    per = _flow(stats)
    as_map = lambda c: F.map_from_entries(F.array_agg(F.when(F.col("position").isNotNull() & F.col(c).isNotNull(), F.struct("position", c))))
    return per.groupBy("school", "season").agg(*[as_map(c).alias(m) for m, c in FLOWS.items()], *_roster_sums())


def _roster_sums() -> list[Column]:
    return [F.sum("production").alias("returning_production"), F.max("impact").alias("returning_player_impact"), F.sum("players").cast("double").alias("roster_player_count")]


def flow_entries(stats: DataFrame) -> DataFrame:
    """``roster_flow`` with one map of structs, ``_entries``, in place of five, and the means of its entries: a position is looked up once for all of them."""
    entry = F.struct("position", F.struct(*[F.col(c).alias(m) for m, c in FLOWS.items()]).alias("entry"))
    entries = F.map_from_entries(F.array_agg(F.when(F.col("position").isNotNull(), entry)))
    flow = _flow(stats).groupBy("school", "season").agg(entries.alias("_entries"), *_roster_sums())
    return flow.withColumns(entry_means(F.col("_entries")))


def player_context(stats: DataFrame, box: list[str]) -> DataFrame:
    """The rows of ``stats`` with the player's season before and career so far: ``prior_...``, ``prior_school``, career columns.

    A player's seasons are sorted once and each looks at the row before, so no season joins another.
    """
    seasons = Window.partitionBy("player").orderBy("season")
    said = ["school", "min_pct", "usage_rate", *box]
    rows = stats.withColumns({
        "_last": F.lag(F.struct("season", *said)).over(seasons),
        "_row": F.row_number().over(seasons),
        "_first": F.min("season").over(Window.partitionBy("player")),
    })
    known = F.col("player").isNotNull() & F.col("season").isNotNull()
    before = known & (F.col("_last")["season"] + 1 == F.col("season"))
    return rows.select(
        *stats.columns,
        F.when(known, F.col("_row") - 1).alias("prior_college_seasons"),
        F.when(known, F.col("_first")).alias("first_observed_season"),
        *[F.when(before, F.col("_last")[c]).alias(f"prior_{c}") for c in said],
    )


def opportunity_frame(stats: DataFrame, box: list[str], facts: DataFrame, projections: DataFrame, transfers: DataFrame, ratings: DataFrame, forecast: str) -> DataFrame:
    """A row per player and season with labels ``min_pct, usage_rate`` and all features.

    ``facts``: by player (height, confidences); ``projections``: by player and season with ``LEAKY`` columns and ``version``, masked unless it is
    ``forecast``; ``transfers``: ``player, season, school, match_confidence`` of known moves; ``ratings``: by school and season, ``team_...``.
    Rows stay one per player and season however often a key repeats in a dimension.
    """
    moved = transfers.groupBy("player", "season", "school").agg(F.max("match_confidence").alias("transfer_match_confidence")).withColumn("is_portal_candidate", F.lit(1.0))
    labels = ["player", "season", "school", "position", "min_pct", "usage_rate"]
    own = player_context(stats.select(*labels, *[c for c in box if c not in labels]), box).drop(*[c for c in box if c not in labels])
    own = enrich(own, (facts, ["player"]), (projections, ["player", "season"])).join(moved, ["player", "season", "school"], "left")
    masked = mask_leaky(own, F.col("version") != forecast, list(LEAKY))
    other = F.when(F.col("prior_school") != F.col("school"), 1.0).otherwise(0.0)
    own = masked.withColumns({"is_transfer": other, "candidate_changes_school": other, "same_school_baseline": F.when(F.col("prior_school") == F.col("school"), 1.0).otherwise(0.0)})
    # features of the player before the team's columns join, those of the team after: the code of all at once is beyond what the JVM compiles
    features = opportunity_features(own.columns)
    names = [n for n in features if n != "missing_feature_count"]
    first = names[: names.index(FIRST_OF_TEAM)]
    inputs = {c: x for c, x in numbers(own.columns).items() if c not in first and c != "season"}
    own = own.select(*labels, *[features[n].alias(n) for n in first], *[x.alias(c) for c, x in inputs.items()])

    # contexts have one row per key as they are
    whole = own.join(position_context(stats), ["school", "season", "position"], "left").join(team_context(stats), ["school", "season"], "left")
    whole = enrich(whole, (ratings, ["school", "season"])).join(flow_entries(stats), ["school", "season"], "left")
    ready = whole.withColumn("_hits", F.transform(position_keys(F.col("position")), lambda k: F.try_element_at("_entries", k))).drop("_entries")
    team = numbers([c for c in ready.columns if c not in own.columns])
    ready = ready.select(*own.columns, *[x.alias(c) for c, x in (team | entries_of_position(F.col("_hits"))).items()])
    features = opportunity_features(ready.columns, clean=True)
    out = ready.select(*labels, *first, *[features[n].alias(n) for n in names if n not in first])
    return out.withColumn("missing_feature_count", missing_count(names))
