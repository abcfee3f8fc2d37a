"""Identity resolution: names of several sources to one entity, in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators.similar import sequence_ratio, similar_pairs, smallest, tokenwise_ratio
from lineup.sources.io import stage

__all__ = ["sequence_ratio", "tokenwise_ratio"]
# Strict and relaxed similarity, the margin between the best two, the limits inside a roster and over all names.
STRICT, RELAXED, MARGIN, IN_ROSTER, OVERALL, CLOSE = 0.82, 0.75, 0.05, 0.88, 0.90, 3


def match_names(names: DataFrame, roster: DataFrame, block: list[str], how: str = "edits", strict: float = STRICT, relaxed: float = RELAXED) -> DataFrame:
    """Per name (``name_id, name, position`` and the block) ``member, confidence, status``.

    ``roster``: ``member, member_name, member_position`` and the block. Candidates have the name's position where the block has any such member. The first of
    three passes with a hit decides: strict, relaxed, relaxed over the whole block. One hit is matched; of several (``CLOSE`` at most) one with the
    name's position is; else the name is ambiguous. A name whose block has no member is ``no_school``. Pairs come from the similarity join of
    distinct names; of members with one name and position the ``CLOSE`` smallest take part.
    """
    left = names.select("name_id", "name", "position", *block)
    right = roster.select("member", "member_name", "member_position", *block)
    sizes = right.groupBy(*block).agg(F.count("*").alias("_n"))
    held = right.groupBy(*block, F.col("member_position").alias("position")).agg(F.lit(True).alias("_held"))
    keys = left.select("name", "position", *block).distinct().join(held, [*block, "position"], "left")
    same = F.coalesce(F.col("member_position") == F.col("position"), F.lit(False))
    pairs = keys.join(similar_pairs(names, right, block, relaxed, how).hint("merge"), [*block, "name"]).where(F.col("score") >= relaxed)
    pairs = pairs.join(smallest(right, [*block, "member_name", "member_position"], "member", CLOSE).hint("merge"), [*block, "member_name"])
    inside = same | F.col("_held").isNull()
    pairs = pairs.withColumn("_pass", F.when(inside & (F.col("score") >= strict), 1).when(inside, 2).otherwise(3))
    # rows of one name, position and block have one answer
    by = [*block, "name", "position"]
    order = Window.partitionBy(*by).orderBy("_pass", F.desc("score"), "member")
    pairs = pairs.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= CLOSE).withColumn("_first", F.min("_pass").over(Window.partitionBy(*by))).where(F.col("_pass") == F.col("_first"))
    hits = pairs.groupBy(*by).agg(
        F.count("*").alias("_hits"),
        F.count_if(same).alias("_same"),
        F.min_by(F.struct("member", "score"), "_row").alias("_best"),
        F.min_by(F.struct("member", "score"), F.when(same, F.col("_row"))).alias("_own"),
    )
    hits = hits.withColumnRenamed("position", "_position")
    left = left.join(sizes, block, "left").alias("l")
    on = [F.col(f"l.{c}") == F.col(f"h.{c}") for c in [*block, "name"]] + [F.col("l.position").eqNullSafe(F.col("h._position"))]
    out = left.join(hits.alias("h").hint("merge"), on, "left").select("l.name_id", "l._n", "_hits", "_same", "_best", "_own")
    found = F.when(F.col("_hits") == 1, F.col("_best")).when(F.col("_same") == 1, F.col("_own"))
    status = F.when(F.col("_n").isNull(), "no_school").when(F.col("_hits").isNull(), "unmatched").when(found.isNotNull(), "matched").otherwise("ambiguous")
    return out.select("name_id", found["member"].alias("member"), F.round(found["score"], 3).alias("confidence"), status.alias("status"))


def match_tokenwise(names: DataFrame, members: DataFrame, block: list[str], least: float, how: str = "edits", margin: float = MARGIN) -> DataFrame:
    """Per name (``name_id, name``) the best member by token similarity, unless it is under ``least`` or the next is within ``margin``.

    The join looks ``margin`` below ``least``, so that every member that can spoil a match is seen; without a block all members are looked through.
    """
    near = similar_pairs(names, members, block, least - margin, how, tokens=True)
    # decided once for all rows of a name and block; scores below the second place decide nothing
    near = near.withColumn("_rank", F.rank().over(Window.partitionBy(*block, "name").orderBy(F.desc("score")))).where("_rank <= 2").drop("_rank")
    pairs = near.join(smallest(members.select("member", "member_name", *block), [*block, "member_name"], "member", 2).hint("merge"), [*block, "member_name"])
    order = Window.partitionBy(*block, "name").orderBy(F.desc("score"), "member")
    pairs = pairs.withColumn("_row", F.row_number().over(order)).where("_row <= 2")
    best = pairs.groupBy(*block, "name").agg(*[F.min(F.when(F.col("_row") == k, F.col(c))).alias(n) for k, c, n in ((1, "member", "member"), (1, "score", "score"), (2, "score", "_next"))])
    best = best.where((F.col("score") >= least) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))).drop("_next")
    return names.select("name_id", "name", *block).join(best.hint("merge"), [*block, "name"]).select("name_id", "member", "score")


def resolve_identities(rows: DataFrame, roster: DataFrame, school: list[str], order: list[str], how: str = "edits") -> DataFrame:
    """Per row (``name_id, name``, the school columns) ``member, tier, exact``: exact name in its school's roster, token match there, a name
    that only one member has anywhere, token match among those names. An id is claimed once: exact before fuzzy, then by ``order``.

    The last tier looks through the names of all schools by signatures, so a name whose initial is misspelt is found and no row meets all members.
    """
    rows = rows.withColumn("_key", F.lower("name"))
    members = roster.select(*school, "member", F.lower("member_name").alias("member_name"))
    exact = members.groupBy(*school, F.col("member_name").alias("_key")).agg(F.min("member").alias("member"))
    one = rows.join(exact, [*school, "_key"]).select("name_id", "member", F.lit(1).alias("tier"))
    lower = rows.select("name_id", *school, F.col("_key").alias("name"))
    two = match_tokenwise(lower, members.dropDuplicates([*school, "member"]), school, IN_ROSTER, how).select("name_id", "member", F.lit(2).alias("tier"))
    unique = members.groupBy("member_name").agg(F.min("member").alias("member"), F.max("member").alias("_last")).where("member = _last").drop("_last")
    three = rows.join(unique.withColumnRenamed("member_name", "_key"), "_key").select("name_id", "member", F.lit(3).alias("tier"))

    four = match_tokenwise(lower.select("name_id", "name"), unique, [], OVERALL, how).select("name_id", "member", F.lit(4).alias("tier"))
    tiers = one.unionByName(two).unionByName(three).unionByName(four)
    first = tiers.groupBy("name_id").agg(F.min_by("member", "tier").alias("member"), F.min("tier").alias("tier"))
    claims = rows.select("name_id", *order).join(first, "name_id").withColumn("exact", F.col("tier").isin(1, 3))
    w = Window.partitionBy("member").orderBy(F.desc("exact"), *order, "name_id")
    held = claims.withColumn("_row", F.row_number().over(w)).where("_row = 1").select("name_id", "member", "tier", "exact")
    return rows.select("name_id").join(held, "name_id", "left")


def direct_then_fuzzy(rows: DataFrame, known: DataFrame, roster: DataFrame, block: list[str], how: str = "edits") -> DataFrame:
    """Per row (``name_id, external, name, position``, block) the member that has the external id, else its name match; ``direct`` says which."""
    ids = known.where(F.col("external").isNotNull()).groupBy("external").agg(F.min("member").alias("_direct"))
    joined = rows.join(ids, "external", "left")
    rest = match_names(joined.where(F.col("_direct").isNull()), roster, block, how)
    sure = joined.where(F.col("_direct").isNotNull()).select("name_id", F.col("_direct").alias("member"), F.lit(1.0).alias("confidence"), F.lit("matched").alias("status"))
    return sure.withColumn("direct", F.lit(True)).unionByName(rest.withColumn("direct", F.lit(False)))


def backfill_ids(known: DataFrame, matched: DataFrame) -> DataFrame:
    """Members (``member, external``) whose external id is NULL take a matched row's, unless another member has or takes it (the smallest member wins)."""
    new = matched.where(F.col("member").isNotNull() & F.col("external").isNotNull()).groupBy("member").agg(F.min("external").alias("_new"))
    free = new.join(known.where(F.col("external").isNotNull()).select(F.col("external").alias("_new")), "_new", "left_anti")
    free = free.join(known.where(F.col("external").isNull()).select("member"), "member", "left_semi").groupBy("_new").agg(F.min("member").alias("member"))
    return known.join(free, "member", "left").withColumn("external", F.coalesce("external", "_new")).drop("_new")


def crosswalk_table(events: DataFrame, schools: DataFrame, roster: DataFrame, how: str = "edits") -> tuple[DataFrame, DataFrame]:
    """Per source actor (``actor``, rows of ``name, team, position``) the commonest name and team, the team's school, the match; and counts by status.

    ``schools``: ``team, school``; ``roster``: ``member, member_name, member_position, school``. Ties of the commonest value go to the smaller one.
    """

    def commonest(c: str) -> DataFrame:
        n = events.where(F.col(c).isNotNull()).groupBy("actor", c).agg(F.count("*").alias("_n"))
        return n.groupBy("actor").agg(F.min_by(c, F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v"))).alias(c))

    actors = commonest("name").join(commonest("team"), "actor", "left").join(commonest("position"), "actor", "left").join(schools, "team", "left")
    # a row an actor; the match reads it several times, which would count the events again
    actors = stage(actors, "actors")
    got = match_names(actors.select(F.col("actor").alias("name_id"), "name", "position", "school"), roster, ["school"], how)
    table = actors.join(got.withColumnRenamed("name_id", "actor"), "actor")
    return table, got.groupBy("status").agg(F.count("*").alias("rows"))


def resolve_from_to(events: DataFrame, schools: DataFrame, roster: DataFrame, how: str = "edits") -> DataFrame:
    """Per event (``name_id, name, position, season, from_team, to_team``) both schools and the player, matched on the season's roster of the school
    that is left, else on the season before where the first says unmatched or ambiguous."""
    at = lambda c: schools.select(F.col("team").alias(f"{c}_team"), F.col("school").alias(f"{c}_school"))
    e = events.join(at("from"), "from_team", "left").join(at("to"), "to_team", "left")
    keyed = e.select("name_id", "name", "position", F.col("from_school").alias("school"), "season")
    first = match_names(keyed, roster, ["school", "season"], how)
    again = keyed.join(first.where(F.col("status").isin("unmatched", "ambiguous")).select("name_id"), "name_id", "left_semi")
    second = match_names(again.withColumn("season", F.col("season") - 1), roster, ["school", "season"], how).where("status = 'matched'")
    second = second.select("name_id", F.col("member").alias("_m"), F.col("confidence").alias("_c"))
    both = first.join(second, "name_id", "left")
    both = both.select("name_id", F.coalesce("member", "_m").alias("member"), F.coalesce("confidence", "_c").alias("confidence"), F.when(F.col("_m").isNotNull(), "matched").otherwise(F.col("status")).alias("status"))
    return e.select("name_id", "from_school", "to_school").join(both, "name_id")
