"""Set operations, upserts and lifecycle merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.operators.windows import latest_per_key


def departure_pairs(*sources: DataFrame) -> DataFrame:
    """Distinct pairs of several evidence sources."""
    return reduce(lambda a, b: a.unionByName(b), sources).distinct()


def membership_union(sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Rows of several sources, the first listed source wins a key."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumns({"source": F.lit(name), "_place": F.lit(k)}) for k, (name, df) in enumerate(sources)])
    return latest_per_key(rows, keys, F.col("_place")).drop("_place")


def merge_lifecycle(df: DataFrame, keys: list[str], status: str, order: list[str], first: list[str]) -> DataFrame:
    """One row per key: the latest stage wins, ``first`` columns keep their earliest value that is not NULL."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return df.groupBy(*keys).agg(F.max_by(status, place).alias(status), *[F.min(c).alias(c) for c in first])


def roster_diff(prior: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Departed, joined and stayed rows, in one full join."""
    a = prior.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = current.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_b").isNull(), "departed").when(F.col("_a").isNull(), "joined").otherwise("stayed").alias("change"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert or replace by key; of repeated keys in the batch the first by ``order`` wins."""
    last = latest_per_key(updates, keys, *order)
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*target.columns))


def upsert_coalesce(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """As an upsert, but ``keep`` columns hold their existing value and no NULL erases a value."""
    rest = [c for c in target.columns if c not in keys]
    t, u = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in rest]), updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in rest])
    both = t.join(u, keys, "full")
    return both.select(*keys, *[(F.coalesce(f"_t_{c}", f"_u_{c}") if c in keep else F.coalesce(f"_u_{c}", f"_t_{c}")).alias(c) for c in rest])


def purge_stale_versions(df: DataFrame, version: str, prefix: str, keep: str) -> DataFrame:
    """Drop rows of older versions of a family."""
    return df.where(~(F.col(version).startswith(prefix) & (F.col(version) != keep)))


def dedup_window(df: DataFrame, key: str, ts: str, confidence: str, tie: str, days: int = 14) -> DataFrame:
    """Of a key's rows in one fixed bucket of days the most confident stays, ties the earliest."""
    bucket = F.floor(F.datediff(F.col(ts), F.lit("2020-01-01")) / days)
    return latest_per_key(df.withColumn("bucket", bucket), [key, "bucket"], F.desc(confidence), F.col(ts), F.col(tie))
