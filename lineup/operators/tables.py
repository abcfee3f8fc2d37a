"""Small table operators: expiry, search, payloads, snapshots, cohorts, coverage and covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators.models import ridge_fit
from lineup.operators.windows import _by, career_index, latest_per_key


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that have not expired; the predicate reaches the scan."""
    return df.where(F.col(expires) > now)


def payload(**fields: Column) -> Column:
    """Named values as a JSON document."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def substring_search(df: DataFrame, column: str, text: str, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows whose column holds a text, letters of either case."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(F.col(column).ilike(f"%{escaped}%")).orderBy(column, *order).limit(n)


def json_get_or_default(json: Column, path: str, default: float) -> Column:
    """A number at a path of a JSON text, or the default where it is not there or no number."""
    return F.coalesce(F.get_json_object(json, path).try_cast("double"), F.lit(float(default)))


def cohort_bucket(x: Column, cuts: list[float], names: list[str]) -> Column:
    """The name of the first cut that a value does not exceed, else the last name."""
    out = F.when(x <= cuts[0], names[0])
    for c, n in zip(cuts[1:], names[1:-1]):
        out = out.when(x <= c, n)
    return out.otherwise(names[-1])


def outer_merge_many(df: DataFrame, keys: list, label: str, values: list[str], agg: Column) -> DataFrame:
    """One column per label, by a pivot of the long form: one shuffle in place of chained outer joins."""
    return df.groupBy(*keys).pivot(label, values).agg(agg)


def snapshot_members(snapshots: DataFrame, members: DataFrame, key, snapshot: str, *order: Column) -> DataFrame:
    """The member rows of each key's latest snapshot."""
    last = latest_per_key(snapshots, key, *order).select(*_by(key), snapshot)
    return last.join(members, snapshot)


def distinct_counts(df: DataFrame, key, **columns: str) -> DataFrame:
    """Exact numbers of distinct values per key."""
    return df.groupBy(*_by(key)).agg(*[F.countDistinct(c).alias(n) for n, c in columns.items()])


def coverage_gaps(rows: DataFrame, expected: DataFrame, key: str, season: str) -> DataFrame:
    """Per season how many expected keys there are and how many have no row; counts suffice, so keys and seasons are not crossed."""
    total = expected.agg(F.count("*").alias("expected"))  # one row
    have = rows.select(key, season).distinct().join(expected.select(key), key, "left_semi").groupBy(season).agg(F.count("*").alias("_n"))
    return have.crossJoin(F.broadcast(total)).select(season, "expected", (F.col("expected") - F.col("_n")).alias("missing"))


def identity_checks(df: DataFrame, **checks: Column) -> DataFrame:
    """The share of rows on which each identity holds."""
    return df.agg(*[F.avg(c.cast("int")).alias(n) for n, c in checks.items()])


def season_covariates(df: DataFrame, key: str, season: str, owner: str, tier: str) -> DataFrame:
    """Career index, whether the owner changed since the season before, and the change of tier; the first season has neither."""
    w = Window.partitionBy(key).orderBy(season)
    moved = F.coalesce(F.col(owner) != F.lag(owner).over(w), F.lit(False)).cast("int")
    change = F.coalesce(F.col(tier) - F.lag(tier).over(w), F.lit(0))
    return career_index(df, key, season).withColumns({"moved": moved, "tier_change": change})


def context_adjust(df: DataFrame, y: str, context: list[str], weight: str | None = None, out: str = "adjusted") -> DataFrame:
    """``y`` without the centred effect of its context, by (weighted) least squares."""
    m = ridge_fit(df, y, context, 0.0, weight)
    effect = F.lit(0.0)
    for c, b, mean in zip(m["features"], m["coef"], m["mean"]):
        effect = effect + b * (F.col(c) - mean)
    return df.withColumn(out, F.col(y) - effect)
