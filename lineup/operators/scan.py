"""Running sums along a key's order that no task computes for a whole key.

A key with more than ``ROWS`` rows is cut into parts of its order by approximate quantiles; the parts' sums are added up in order (a row a part), and each part
runs its own window from there. Keys of few rows are one part. Rows of one value of the first order column stay in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators.order import join_keys

ROWS, MOST = 100_000, 1_000


def parts_of(df: DataFrame, key: list[str], first: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_part``: the place of the row's part in its key's order; NULLs of the order column come first, in part 0."""
    size = df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    large = join_keys(df.where(F.col(first).isNotNull()).select(*key, first), size, key)
    # the quantiles that a key of its size needs, out of those of all sizes
    cuts = large.groupBy(*key).agg(F.max("_n").alias("_n"), F.percentile_approx(first, [k / MOST for k in range(1, MOST)], 10_000).alias("_cuts"))
    step = F.greatest(F.lit(1), F.floor(MOST * rows / F.col("_n")).cast("int"))
    cuts = cuts.select(*key, F.filter("_cuts", lambda c, i: (i + 1) % step == 0).alias("_cuts"))
    out = join_keys(df, cuts, key, "left")
    return out.withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(first))), F.lit(0))).drop("_cuts")


def sum_before(df: DataFrame, key, order: list, value: Column, out: str, first: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the key's rows before the row, 0 for the first.

    ``order``: columns or expressions with full tie-breaks, ``first`` ascending before all others; ``first`` is a number, date or timestamp column.
    """
    key = [key] if isinstance(key, str) else list(key)
    df = parts_of(df, key, first, rows).withColumn("_value", value)
    sums = df.groupBy(*key, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part, so MOST at most
    sums = sums.withColumn("_base", F.sum("_sum").over(earlier)).where(F.col("_base").isNotNull()).select(*key, "_part", "_base")
    inside = Window.partitionBy(*key, "_part").orderBy(F.asc_nulls_first(first), *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.sum("_value").over(inside))
    df = join_keys(df, sums, key, "left", ["_part"])
    zero = F.lit(0)
    return df.withColumn(out, F.coalesce("_base", zero) + F.coalesce("_inside", zero)).drop("_part", "_value", "_base", "_inside")
