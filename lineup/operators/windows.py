"""Window operators: ranks, tiers, segments, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.scalars import with_score
from lineup.operators.order import average_rank, join_keys, quantiles, rank_table, ranked
from lineup.operators.scan import sum_before


def _by(keys) -> list:
    return [keys] if isinstance(keys, str) else list(keys)


def with_average_rank(df: DataFrame, value: str, group, out: str) -> DataFrame:
    """Rank among the group's non-null values, ties share their mean rank; NULL stays NULL."""
    return ranked(df, group, value).withColumn(out, average_rank()).select(*df.columns, out)


def calibrate_within(df: DataFrame, group, value: str, out: str) -> DataFrame:
    """Mid-rank percentile in the group as a normal score between 10 and 90."""
    kept = [c for c in df.columns if c != out]
    scored = with_score(ranked(df, group, value), (average_rank() - 0.5) / F.col("_n"), out)
    return scored.select(*kept, out)


def calibrate_many(df: DataFrame, group, values: dict[str, str]) -> DataFrame:
    """W01 for several columns (value -> score), each ranked from ``df`` itself; ``df`` should be a table, as every column reads it."""
    g, out = _by(group), df
    for value, name in values.items():
        own = rank_table(df, g, value)
        out = with_score(join_keys(out, own, g, "left", [value]), (average_rank() - 0.5) / F.col("_n"), name).drop("_before", "_ties", "_n")
    return out


def competition_tier(df: DataFrame, group, value: str, out: str, rule: str = "min", cuts=(0.75, 0.45, 0.20)) -> DataFrame:
    """Tier 1 (top) to 4 by percentile; ``rule`` names how ties count: min, average or share. A NULL value is in tier 4."""
    if rule == "min":
        p = F.when(F.col("_n") > 1, F.col("_before") / (F.col("_n") - 1)).otherwise(0.0)
    elif rule == "share":
        p = (F.col("_before") + F.col("_ties")) / F.col("_n")
    else:
        p = average_rank() / F.col("_n")
    return ranked(df, group, value).withColumn(out, F.when(p >= cuts[0], 1).when(p >= cuts[1], 2).when(p >= cuts[2], 3).otherwise(4)).select(*df.columns, out)


def quantile_bucket(df: DataFrame, group, value: str, out: str, n: int = 4) -> DataFrame:
    """Bucket 1..n by the group's exact quantile edges; edges that coincide merge."""
    edges = quantiles(df, group, F.col(value), [k / n for k in range(1, n)], "_edges").withColumn("_edges", F.array_distinct("_edges"))
    joined = join_keys(df, edges, _by(group), "left")
    return joined.withColumn(out, F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1).select(*df.columns, out)


def pct_rank(df: DataFrame, group, value: str, out: str, inverted: bool = False) -> DataFrame:
    """Average-rank percentile 0-100, flipped for metrics where less is better."""
    p = 100 * average_rank() / F.col("_n")
    return ranked(df, group, value).withColumn(out, 100 - p if inverted else p).select(*df.columns, out)


def zscore_by(df: DataFrame, group, value: str, out: str) -> DataFrame:
    """Population z-score, 0 where the group has one value or no spread; the groups' means and deviations are joined back."""
    stats = df.groupBy(*_by(group)).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when((F.col("_n") >= 2) & (F.col("_sd") > 0), (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return join_keys(df, stats, _by(group), "left").withColumn(out, z).select(*df.columns, out)


def career_index(df: DataFrame, key, order, out: str = "career_index") -> DataFrame:
    """1, 2, ... along each key's order; keys of any size, see ``scan``."""
    first, *rest = _by(order)
    return sum_before(df, _by(key), rest, F.lit(1), "_before", first).withColumn(out, (F.col("_before") + 1).cast("int")).drop("_before")


def lag1_autocorr(df: DataFrame, key, order, value: str, least: int = 50, low: float = 0.2, high: float = 0.95) -> DataFrame:
    """Pooled correlation of a value with the key's next one, held between bounds; NULL under ``least`` pairs."""
    pairs = df.withColumn("_next", F.lead(value).over(Window.partitionBy(*_by(key)).orderBy(*_by(order)))).where(F.col("_next").isNotNull() & F.col(value).isNotNull())
    return pairs.agg(F.count("*").alias("pairs"), F.corr(value, "_next").alias("_r")).select("pairs", F.when(F.col("pairs") >= least, F.least(F.greatest("_r", F.lit(low)), F.lit(high))).alias("rho"))


def segment_id(df: DataFrame, key, order, boundary: Column, out: str = "segment_id") -> DataFrame:
    """Number of boundaries before the row, so a boundary row ends its segment; keys of any size, see ``scan``."""
    first, *rest = _by(order)
    return sum_before(df, _by(key), rest, F.coalesce(boundary.cast("bigint"), F.lit(0)), out, first)


def group_max_flag(df: DataFrame, key, value: str, out: str) -> DataFrame:
    """Whether the row holds its group's largest value."""
    return df.withColumn(out, F.col(value) == F.max(value).over(Window.partitionBy(*_by(key))))


def latest_per_key(df: DataFrame, key, *order: Column) -> DataFrame:
    """The first row of each key by an order with full tie-breaks."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*_by(key)).orderBy(*order))).where("_row = 1").drop("_row")


def priority_resolve(df: DataFrame, key, label: str, priorities: list, *order: Column) -> DataFrame:
    """One row per key by a label's place in a list (others last), then the order."""
    place = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(label))
    return latest_per_key(df.withColumn("_place", F.when(place > 0, place).otherwise(len(priorities) + 1)), key, F.col("_place"), *order).drop("_place")


def national_percentile(df: DataFrame, value: str, group, whole: str = "national_pct", rank: str = "group_rank", season="season") -> DataFrame:
    """Cumulative share in the season and rank in the group, best first, ties share."""
    groups = [*_by(season), *_by(group)]
    share = ranked(df, season, value).withColumn(whole, 100 * (F.col("_before") + F.col("_ties")) / F.col("_n")).select(*df.columns, whole)
    own = join_keys(share, rank_table(df, groups, value), groups, "left", [value])  # ranked from the rows themselves, not from the joined ones
    return own.withColumn(rank, (F.col("_n") - F.col("_before") - F.col("_ties") + 1).cast("int")).select(*share.columns, rank)


def cascade_reduce(df: DataFrame, key, value: str, total: Column, order, out: str = "reduced") -> DataFrame:
    """Take ``total`` from the key's rows in order (smallest first) until it is used up; keys of any size where the order begins with a column's name."""
    if isinstance(order[0], str):
        df = sum_before(df, _by(key), order[1:], F.col(value), "_before", order[0])
    else:
        w = Window.partitionBy(*_by(key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0.0)))
    return df.withColumn(out, F.least(F.col(value), F.greatest(F.lit(0.0), total - F.col("_before")))).drop("_before")


def qualifying_owner(df: DataFrame, key, owner: str, order: str, condition: Column) -> DataFrame:
    """The owner of each segment's first qualifying row."""
    return df.where(condition).groupBy(*_by(key)).agg(F.min_by(owner, order).alias("owner"))
