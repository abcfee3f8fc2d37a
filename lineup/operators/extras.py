"""Gates, cohort summaries, rosters and run comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators.order import join_keys, quantiles


def quality_gate(df: DataFrame, floors: dict[str, float], features: list[str], most_missing: int) -> DataFrame:
    """Rows above floors with at most so many missing features."""
    missing = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in features])
    return threshold_filters(df, {}, floors).where(missing <= most_missing)


def threshold_filters(df: DataFrame, lists: dict[str, list], floors: dict[str, float]) -> DataFrame:
    """List filters and minimum floors from a spec; unknown columns are ignored, NULL fails."""
    for c, values in lists.items():
        df = df.where(F.col(c).isin(values)) if c in df.columns else df
    for c, low in floors.items():
        df = df.where(F.col(c) >= low) if c in df.columns else df
    return df


def both_sides_in(df: DataFrame, ids: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """Rows whose two ids are both in a reference set."""
    for c in (one, other):
        df = df.join(ids.select(F.col(key).alias(c)), c, "left_semi")
    return df


def shot_class(points: Column, label: Column, rim: list[str], distance: Column, three: float) -> Column:
    """Rim, three or mid; without recorded points the distance decides what a three is."""
    return F.when(F.coalesce(points == 3, distance > three), "three").when(label.isin(rim), "rim").otherwise("mid")


def actor_from_text(text: Column, markers: list[str]) -> Column:
    """What stands before the first listed marker that occurs."""
    return F.coalesce(*[F.when(F.instr(text, m) > 1, F.trim(F.substring_index(text, m, 1))) for m in markers])


def unit_autodetect(df: DataFrame, column: str, out: str, limit: float = 1.5) -> DataFrame:
    """Percentages or shares, told by the median of the positive values, as shares between 0 and 1."""
    middle = df.sparkSession.range(1).join(quantiles(df.where(F.col(column) > 0), [], F.col(column), [0.5]), how="left").select(F.get("quantiles", F.lit(0)).alias("_m"))  # one row
    x = F.when(F.col("_m") > limit, F.col(column) / 100).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(middle)).withColumn(out, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))).drop("_m")


def mask_leaky(df: DataFrame, leaky: Column, columns: list[str]) -> DataFrame:
    """P20: NULL out columns where their source leaks."""
    return df.withColumns({c: F.when(~F.coalesce(leaky, F.lit(False)), F.col(c)) for c in columns})


def combine_memberships(a: Column, b: Column, n: int) -> Column:
    """Products of two membership arrays, the n largest."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct((-x["weight"] * y["weight"]).alias("minus"), x["cluster"].alias("a"), y["cluster"].alias("b")))))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), (-p["minus"]).alias("weight")))


def success_label(actual: Column, projected: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """Actual against projected, else after against before, else unknown; and which rule decided."""
    first, second = actual.isNotNull() & projected.isNotNull(), before.isNotNull() & after.isNotNull()
    return F.when(first, actual >= projected).when(second, after >= before), F.when(first, "projected").when(second, "earlier").otherwise("none")


def soft_position_sum(df: DataFrame, key: str, value: str, shares: str, names: list[str]) -> DataFrame:
    """Totals by position weighted by a probability vector."""
    return df.groupBy(key).agg(*[F.coalesce(F.sum(F.col(value) * F.get(F.col(shares), F.lit(k))), F.lit(0.0)).alias(n) for k, n in enumerate(names)])


def distribution_deficit(df: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """A10: classes where an entity's share falls most short of the league's."""
    own = df.groupBy(key, label).agg(F.count("*").alias("n"))
    whole = own.groupBy(label).agg(F.sum("n").alias("league"))
    total = whole.agg(F.sum("league").alias("_t"))
    league = whole.crossJoin(F.broadcast(total)).select(label, (F.col("league") / F.col("_t")).alias("league"))  # a row per class
    keys = own.groupBy(key).agg(F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("_n"))
    # every key meets every class: classes are few, or their table is joined whole by a constant key
    rows = (keys.crossJoin(F.broadcast(league)) if league.limit(10_001).count() <= 10_000 else keys.withColumn("_one", F.lit(1)).join(league.withColumn("_one", F.lit(1)), "_one")).select(key, F.col(label).alias("label"), F.round(F.col("league") - F.coalesce(F.col("_n")[F.col(label)], F.lit(0)) / F.col("_all"), 9).alias("deficit"))
    w = Window.partitionBy(key).orderBy(F.desc("deficit"), "label")
    return rows.where("deficit > 0").withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def roster_state(df: DataFrame, group: str, key: str, season: str, value: str, before: int, now: int) -> DataFrame:
    """Prior, returning and departing totals and incoming members, from one tagged long table."""
    per = df.groupBy(group, key).agg(F.sum(F.when(F.col(season) == before, F.col(value))).alias("_b"), F.max(F.when(F.col(season) == now, 1)).alias("_n"))
    b = F.coalesce("_b", F.lit(0.0))
    return per.groupBy(group).agg(F.sum(b).alias("prior"), F.sum(F.when(F.col("_n") == 1, b).otherwise(0.0)).alias("returning_"), F.sum(F.when(F.col("_n").isNull(), b).otherwise(0.0)).alias("departing"), F.count_if(F.col("_b").isNull()).alias("incoming"))


def attempt_rates(df: DataFrame, key: str, totals: dict[str, str], minutes: str, floor: float, per: float = 40.0) -> DataFrame:
    """Totals per 40 minutes over a minutes floor."""
    g = df.groupBy(key).agg(F.sum(minutes).alias("_m"), *[F.sum(c).alias(n) for n, c in totals.items()])
    return g.where(F.col("_m") >= floor).select(key, *[(F.col(n) * per / F.col("_m")).alias(n) for n in totals])


def tier_matrix(df: DataFrame, source: str, target: str, value: str, least: int = 20) -> DataFrame:
    """4 x 4 effects: a directional prior (-.25 a step up, +.15 a step down), blended 4:1 with cells of enough rows."""
    spark = df.sparkSession
    grid = spark.range(16).select((F.floor(F.col("id") / 4) + 1).cast("int").alias("source_tier"), (F.col("id") % 4 + 1).cast("int").alias("target_tier"))
    a, b = F.col("source_tier"), F.col("target_tier")
    prior = F.when(b < a, -0.25 * (a - b)).otherwise(0.15 * (b - a))
    cells = df.groupBy(F.col(source).alias("source_tier"), F.col(target).alias("target_tier")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    out = F.broadcast(grid).join(cells, ["source_tier", "target_tier"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("effect", F.when(F.col("n") >= least, 0.8 * prior + 0.2 * F.col("mean")).otherwise(prior))


def residual_summary(df: DataFrame, y: str, p: str, key: str, least: int) -> DataFrame:
    """Residual statistics of groups with enough rows."""
    e = F.col(p) - F.col(y)
    middle = quantiles(df, key, F.round(e, 6), [0.5]).select(key, F.get("quantiles", F.lit(0)).alias("median"))
    stats = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).where(F.col("n") >= least)
    return join_keys(stats, middle, [key], "left").select(key, "n", "mean", "median", "rmse", "mae")


def baseline_compare(df: DataFrame, train: Column, y: str, p: str, group: str) -> DataFrame:
    """RMSE of a model, the training mean and the training group mean on the other rows."""
    tagged = df.withColumn("_train", train)
    means = tagged.where("_train").groupBy(group).agg(F.avg(y).alias("_g"), F.sum(y).alias("_s"), F.count(y).alias("_n"))
    whole = means.agg((F.sum("_s") / F.sum("_n")).alias("_w"))
    test = tagged.where(~F.col("_train")).join(means.select(group, "_g"), group).crossJoin(F.broadcast(whole))
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y))))
    return test.agg(rmse(p).alias("model"), rmse("_w").alias("mean"), rmse("_g").alias("group_mean"))


def classification_eval(df: DataFrame, p: str, y: str) -> DataFrame:
    """Accuracy, accuracy of each class, false positive rate."""
    a, b = F.col(p), F.col(y)
    return df.agg(
        F.count("*").alias("n"), F.avg((a == b).cast("int")).alias("accuracy"), (F.count_if((a == 1) & (b == 1)) / F.nullif(F.count_if(b == 1), F.lit(0))).alias("positive_accuracy"),
        (F.count_if((a == 0) & (b == 0)) / F.nullif(F.count_if(b == 0), F.lit(0))).alias("negative_accuracy"), (F.count_if((a == 1) & (b == 0)) / F.nullif(F.count_if(b == 0), F.lit(0))).alias("false_positive_rate"),
    )


def scenario_compare(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Margin, overlap of intervals and the preferred of two scenarios."""
    side = lambda s: df.select(F.col(key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("value", "low", "high")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    margin = F.col("a_value") - F.col("b_value")
    return both.select("a", "b", margin.alias("margin"), ((F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).alias("overlap"), F.when(margin > 0, "a").when(margin < 0, "b").otherwise("tie").alias("preferred"))


def upsert_partial(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], stub: dict) -> DataFrame:
    """Only the listed columns are updated; new pairs get stub values for the rest."""
    rest = [c for c in target.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    both = target.join(u, keys, "full")
    return both.select(*keys, *[F.coalesce(f"_u_{c}", c).alias(c) if c in columns else F.coalesce(F.col(c), F.lit(stub.get(c))).alias(c) for c in rest])


def ingest_fact(df: DataFrame, kinds: dict[str, str], dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Typed facts with resolved keys; what has no match stays with NULL keys."""
    df = df.withColumns({c: F.col(c).cast("string").try_cast(k) for c, k in kinds.items()})
    for dim, key in dims:
        df = df.join(dim.dropDuplicates([key]), key, "left")
    return df


def rolling_origin_mean(df: DataFrame, season: str, y: str, folds: list[int]) -> DataFrame:
    """Each fold trains on earlier seasons only; season sums are enough, so rows are not copied per fold."""
    per = df.groupBy(season).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    w = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)  # a row per season
    before = per.select(F.col(season), (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("_m")).where(F.col(season).isin(folds))
    return df.join(F.broadcast(before), season).groupBy(F.col(season).alias("fold")).agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col(y) - F.col("_m")) ** 2)).alias("rmse"))


def champion_gate(runs: DataFrame, order: str, metric: str, gain: float) -> DataFrame:
    """A run is promoted if it beats the current best by more than ``gain`` (the first always); runs are few."""
    listed = runs.agg(F.array_sort(F.collect_list(F.struct(order, metric))).alias("r"))
    kind = f"struct<best:double,out:array<struct<{order}:{dict(runs.dtypes)[order]},{metric}:double,promoted:boolean>>>"
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().alias("out")).cast(kind)

    def step(s, r):
        won = s["best"].isNull() | (r[metric] < (1 - gain) * s["best"])
        row = F.array(F.struct(r[order].alias(order), r[metric].alias(metric), won.alias("promoted")))
        return F.struct(F.when(won, r[metric]).otherwise(s["best"]).alias("best"), F.concat(s["out"], row).alias("out"))

    return listed.select(F.explode(F.aggregate("r", start, step)["out"]).alias("x")).select("x.*")


def sessionize(df: DataFrame, key: str, ts: str, tie: str, gap: int, boundary: Column) -> DataFrame:
    """A new session after a gap of seconds or after a boundary event."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    late = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap
    cut = F.coalesce(late, F.lit(False)) | F.coalesce(F.lag(boundary).over(w), F.lit(False))
    return df.withColumn("_cut", cut.cast("int")).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")
