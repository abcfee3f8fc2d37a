"""Exact ranks and percentiles that no task computes for a whole group: approximate cuts split a group, counts of values fill in the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks: parts of a group; each is sorted by a task of its own. Percentiles: half the width of the bracket of ranks around one, and the sketch's accuracy.
PARTS, BRACKET, ACCURACY = 64, 0.002, 2_000
#: Rows of a table of groups that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Rows of a group that one task may order; only larger groups are split.
FEW = 100_000


def few_rows(df: DataFrame) -> DataFrame:
    """A table of few rows as a broadcast of its rows, so that it is not computed again; a larger one as it is."""
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= BROADCAST_ROWS else df


def _list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_keys(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", more: list[str] = ()) -> DataFrame:
    """``df`` with the columns of ``table`` whose keys are equal, NULL keys too; ``more`` are compared plainly."""
    every = [*keys, *more]
    own = table.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(every)], *[c for c in table.columns if c not in every])
    if not every:
        return df.crossJoin(F.broadcast(own))  # one row
    same = [df[k].eqNullSafe(own[f"_key{i}"]) if i < len(keys) else df[k] == own[f"_key{i}"] for i, k in enumerate(every)]
    return df.join(own, same, how).drop(*[f"_key{i}" for i in range(len(every))])


def _large(rows: DataFrame, g: list[str]) -> DataFrame | None:
    """The groups of more than ``FEW`` rows with ``_n``, broadcast if they are not many; None if there are none."""
    large = rows.groupBy(*g).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW)
    held = large.limit(BROADCAST_ROWS + 1).collect()
    if not held:
        return None
    return F.broadcast(rows.sparkSession.createDataFrame(held, large.schema)) if len(held) <= BROADCAST_ROWS else large


def rank_table(df: DataFrame, group, value: str) -> DataFrame:
    """A row per group and value: ``_before`` (rows of the group with a smaller value), ``_ties`` (with the same) and ``_n`` (with any).

    Where no group has more than ``FEW`` rows, its values are counted and put in order by one task. Else a
    group's distinct values are dealt to ``PARTS`` parts by approximate cuts; counts of the parts are summed, and running sums are taken inside a part.
    """
    g = _list(group)
    rows = df.where(F.col(value).isNotNull()).select(*g, value)
    if _large(rows, g) is None:
        counts = rows.groupBy(*g, value).agg(F.count("*").alias("_ties"))
        w = Window.partitionBy(*g)
        before = F.coalesce(F.sum("_ties").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(*g, value, before.alias("_before"), "_ties", F.sum("_ties").over(w).alias("_n"))
    cuts = rows.groupBy(*g).agg(F.count("*").alias("_n"), F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    counts = join_keys(rows.groupBy(*g, value).agg(F.count("*").alias("_ties")), few_rows(cuts), g)
    counts = counts.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    parts = counts.groupBy(*g, "_part").agg(F.sum("_ties").alias("_sum"))
    before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*g, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*g, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
    return join_keys(counts, parts, g, more=["_part"]).select(*g, value, (F.col("_base") + F.col("_inside")).alias("_before"), "_ties", "_n")


def ranked(df: DataFrame, group, value: str) -> DataFrame:
    """``df`` with the columns of ``rank_table``, NULL for a NULL value."""
    g = _list(group)
    return join_keys(df, rank_table(df, g, value), g, "left", [value])


def average_rank() -> Column:
    """Of ``ranked`` rows: ties share their mean rank, from 1."""
    return F.col("_before") + (F.col("_ties") + 1) / 2


def quantiles(df: DataFrame, keys, value: Column, probs: list[float], out: str = "quantiles") -> DataFrame:
    """Per key the exact interpolated percentiles of the non-null values as an array; keys without a value are left out.

    A group of ``FEW`` rows or less is one buffer. For a larger one, a sketch brackets the rank of each percentile in a first scan; in a second one the
    rows below each bracket are counted, and only the few values inside it are put in order.
    """
    g = _list(keys)
    rows = df.select(*g, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    large = _large(rows, g)
    direct = lambda some: some.groupBy(*g).agg(F.percentile("_v", list(probs)).alias(out)).where(F.col(out).isNotNull())
    if large is None:
        return direct(rows)
    known = join_keys(rows, large, g, "left" if g else "inner")
    return direct(known.where(F.col("_n").isNull())).unionByName(_bracketed(known.where(F.col("_n").isNotNull()), g, probs, out))


def _bracketed(rows: DataFrame, g: list[str], probs: list[float], out: str) -> DataFrame:
    """Percentiles of large groups; ``rows``: keys, ``_v`` and the group's ``_n``."""
    ends = [x for p in probs for x in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    brackets = rows.groupBy(*g).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_ends"))
    near = join_keys(rows, few_rows(brackets), g)
    v, end = F.col("_v"), lambda k: F.get("_ends", F.lit(k))
    # cells between the brackets' ends are in the order of the values; a row outside all brackets only counts for its cell
    cell, inside = F.lit(0), F.lit(False)
    for k in range(len(ends)):
        cell = cell + (end(k) < v).cast("int")
    for i in range(len(probs)):
        inside = inside | ((v >= end(2 * i)) & (v <= end(2 * i + 1)))
    counts = near.groupBy(*g, "_n", cell.alias("_cell"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*g).orderBy("_cell", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(w), F.lit(0))).where(F.col("_v").isNotNull())

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c")), F.col("_v")))

    ranks = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    pairs = [F.struct(at(F.floor(r)).alias("a"), at(F.ceil(r)).alias("b"), F.first(r - F.floor(r)).alias("part")) for r in ranks]
    found = counts.groupBy(*g).agg(F.array(*pairs).alias(out))
    return found.withColumn(out, F.transform(out, lambda x: x["a"] + (x["b"] - x["a"]) * x["part"]))
