"""Ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, key, n: int, *order: Column, out: str = "place") -> DataFrame:
    """The first ``n`` rows of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def two_stage_topk(df: DataFrame, user: str, item: str, first: Column, second: Column, wide: int = 50, narrow: int = 10) -> DataFrame:
    """The ``wide`` best by default weights, of these the ``narrow`` best by the user's."""
    shortlist = top_n(df.withColumn("stage1", first), user, wide, F.desc("stage1"), F.col(item), out="place1")
    return top_n(shortlist.withColumn("stage2", second), user, narrow, F.desc("stage2"), F.col(item), out="place2")


def top_features(vector: Column, names: list[str], n: int) -> Column:
    """The largest positive entries with their names."""
    pairs = F.transform(vector, lambda v, i: F.struct((-v).alias("minus"), F.get(F.array(*[F.lit(x) for x in names]), i).alias("name")))
    return F.transform(F.slice(F.array_sort(F.filter(pairs, lambda p: p["minus"] < 0)), 1, n), lambda p: p["name"])


def best_of(df: DataFrame, key, item: str, metrics: list[str]) -> DataFrame:
    """The best item of each metric."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*[F.max_by(item, F.struct(F.col(m), -F.col(item))).alias(f"best_{m}") for m in metrics])


def largest_key(values: Column) -> Column:
    """The key of a map's largest value, ties to the smaller key."""
    return F.array_min(F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"))))["key"]


def explain_funnel(df: DataFrame, key: str, item: str, score: str, cutoff: int) -> DataFrame:
    """Every candidate's place, the cut-off score of its key and the margin to it."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("place", F.row_number().over(w.orderBy(F.desc(score), item)))
    limit = F.min(F.when(F.col("place") <= cutoff, F.col(score))).over(w)
    return ranked.withColumns({"cutoff": limit, "margin": F.col(score) - limit, "kept": F.col("place") <= cutoff})


def explain_two_stage(df: DataFrame, key: str, item: str, weights: dict[str, float], second: Column, wide: int = 50, narrow: int = 10) -> DataFrame:
    """Places, cut-offs and margins of both stages, the stage reached, the weakest weighted component and a reason, for every candidate."""
    parts = [F.col(c) * w for c, w in weights.items()]
    one = explain_funnel(df.withColumn("stage1", sum(parts[1:], parts[0])), key, item, "stage1", wide).withColumnsRenamed({"place": "place1", "cutoff": "cutoff1", "margin": "margin1", "kept": "in1"})
    w = Window.partitionBy(key, "in1")
    two = one.withColumn("stage2", F.when(F.col("in1"), second)).withColumn("place2", F.when(F.col("in1"), F.row_number().over(w.orderBy(F.desc("stage2"), item))))
    two = two.withColumn("cutoff2", F.min(F.when(F.col("place2") <= narrow, F.col("stage2"))).over(w)).withColumn("margin2", F.col("stage2") - F.col("cutoff2"))
    weakest = F.array_min(F.array(*[F.struct(p.alias("part"), F.lit(k).alias("at"), F.lit(c).alias("name")) for k, (p, c) in enumerate(zip(parts, weights))]))["name"]
    stage = F.when(~F.col("in1"), f"top_{wide}_excluded").when(F.col("place2") > narrow, f"top_{narrow}_excluded").otherwise("selected")
    out = two.withColumns({"weakest": weakest, "stage": stage})
    lost = lambda k, n: F.format_string(f"Ranked %d in Stage {k}, %.4f below the Top-{n} cutoff; weakest weighted component was %s.", F.col(f"place{k}"), F.abs(f"margin{k}"), F.col("weakest"))
    reason = F.when(~F.col("in1"), lost(1, wide)).when(F.col("place2") > narrow, lost(2, narrow)).otherwise(F.format_string("Ranked %d in Stage 2, selected.", F.col("place2")))
    return out.withColumn("reason", reason).drop("in1")
