"""Season replacement, membership status and group priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def season_replace(target: DataFrame, fresh: DataFrame, season: str) -> DataFrame:
    """The rows of ``fresh`` in place of the target's rows of the same seasons."""
    return target.join(fresh.select(season).distinct(), season, "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def returning_status(df: DataFrame, key: str, season: str, owner: str, freshman: Column) -> DataFrame:
    """Returning, transfer_in or new, by the owner one season earlier; a freshman is new. One row per key and season."""
    before = df.select(F.col(key), (F.col(season) + 1).alias(season), F.col(owner).alias("_before"))
    same = F.col("_before") == F.col(owner)
    status = F.when(F.coalesce(freshman, F.lit(False)) | F.col("_before").isNull(), "new").when(same, "returning").otherwise("transfer_in")
    return df.join(before, [key, season], "left").withColumn("status", status).drop("_before")


def group_priors(df: DataFrame, group: str, newcomer: Column, label: str, weight: Column, prediction: Column) -> DataFrame:
    """Predictions blended with the newcomers' mean label of their group, or of all newcomers where a group has none."""
    sums = df.where(newcomer).groupBy(group).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    means = sums.where("_n > 0").select(group, (F.col("_s") / F.col("_n")).alias("_mean"))
    whole = sums.agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("_whole"))  # one row
    prior = F.coalesce("_mean", "_whole")
    both = df.join(means, group, "left").crossJoin(F.broadcast(whole))
    return both.withColumns({"prior": prior, "blended": F.coalesce(weight * prior + (1 - weight) * prediction, prediction)}).drop("_mean", "_whole")
