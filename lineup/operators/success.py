"""Success of moves: rates that see earlier seasons only, levels that shrink to each other, a coefficient fitted season by season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.scalars import logit, sigmoid
from lineup.operators.aggregates import shrink_chain

#: Seasons are counted from here, so that powers of the decay stay near 1.
BASE_SEASON = 2000
#: Cuts of the five success tiers. Fixed values.
SUCCESS_CUTS = [0.35, 0.5, 0.65, 0.8]


def expanding_rates(df: DataFrame, y: str, season: str, levels: list[list[str]], decay: float = 0.9) -> DataFrame:
    """For each level k of key lists, ``n_k`` (decayed number of labelled rows of the key in earlier seasons) and ``r_k`` (their decayed rate).

    Rows are summed to one per key and season before anything is ordered, so a window sees as many rows as there are seasons, and a season looks
    up its own entry: no row meets another one. A key without earlier rows has ``n_k`` 0 and ``r_k`` NULL; NULL keys are a key of their own.
    """
    age = F.col(season) - BASE_SEASON
    for k, keys in enumerate(levels):
        per = df.groupBy(*keys, season).agg(F.count(y).alias("_n"), F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("_good"))
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
        past = lambda c: F.coalesce(F.sum(F.col(c) * F.pow(F.lit(decay), -age)).over(w), F.lit(0.0)) * F.pow(F.lit(decay), age)
        per = per.withColumns({f"n_{k}": past("_n"), "_past": past("_good")}).withColumn(f"r_{k}", F.col("_past") / F.nullif(F.col(f"n_{k}"), F.lit(0.0)))
        side = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, season])], f"n_{k}", f"r_{k}")
        on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, season])]
        df = df.join(side, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    return df


def shrunk_rate(levels: int, k: float = 15.0) -> Column:
    """A17 over the columns of ``expanding_rates``, coarse to fine; 0.5 where no season came before."""
    chain = shrink_chain([(F.col(f"r_{i}"), F.col(f"n_{i}")) for i in range(levels)], k)
    return F.when(F.col("n_0") > 0, chain).otherwise(0.5)


def deciding_level(names: list[str]) -> Column:
    """The finest level with earlier rows, ``bootstrap`` without any."""
    out = F.lit("bootstrap")
    for i, name in enumerate(names):
        out = F.when(F.col(f"n_{i}") > 0, name).otherwise(out)
    return out


def expanding_beta(df: DataFrame, y: str, offset: str, x: str, season: str, low: float = -5.0, high: float = 0.0, ridge: float = 0.25, rounds: int = 4, points: int = 17) -> dict[int, float]:
    """M21 season by season: the coefficient of ``x`` in [low, high] with the least penalised logistic loss over the rows of all earlier seasons.

    The loss is convex: every round lays a grid around the best point so far of each season and one aggregate over the rows sums the losses of all
    seasons' grids, so the jobs are as many as the rounds. A row is copied for the seasons after it (tens) and the points of their grids, and the
    copies are summed before the shuffle. What comes to the driver is a number a season. Nearly nothing (below 0.01) is 0, as is a season
    whose earlier rows have one value of ``x`` only.
    """
    kind = {y: "double", offset: "double", x: "double", season: "int"}
    rows = df.select(*[F.col(c).cast(t).alias(n) for (c, t), n in zip(kind.items(), ("y", "o", "x", "s"))]).dropna()
    spans = rows.groupBy("s").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("s").collect()  # a row a season
    if not spans:
        return {}
    last = spans[-1]["s"]
    state, a, b = {}, float("inf"), float("-inf")
    by = {r["s"]: r for r in spans}
    for s in range(spans[0]["s"] + 1, last + 2):
        if s - 1 in by:
            a, b = min(a, by[s - 1]["a"]), max(b, by[s - 1]["b"])
        if b - a > 1e-9:
            state[s] = (low, high, low)
    for _ in range(rounds if state else 0):
        grids = {s: [lo + (hi - lo) * i / (points - 1) for i in range(points)] for s, (lo, hi, _) in state.items()}
        literal = F.create_map(*[e for s, g in grids.items() for e in (F.lit(s), F.array(*[F.lit(float(v)) for v in g]))])
        later = rows.select("*", F.explode(F.sequence(F.col("s") + 1, F.lit(last + 1))).alias("at"))
        p = F.least(F.greatest(sigmoid(F.col("o") + F.col("beta") * F.col("x")), F.lit(1e-9)), F.lit(1 - 1e-9))
        losses = later.select("*", F.explode(F.try_element_at(literal, F.col("at"))).alias("beta")).groupBy("at", "beta").agg(F.sum(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("loss"))
        best = losses.groupBy("at").agg(F.min_by("beta", F.struct(F.col("loss") + ridge * F.col("beta") * F.col("beta"), F.abs("beta"))).alias("beta")).collect()
        for r in best:
            lo, hi, _ = state[r["at"]]
            step = (hi - lo) / (points - 1)
            state[r["at"]] = (max(low, r["beta"] - step), min(high, r["beta"] + step), r["beta"])
    return {s: 0.0 if abs(v) < 0.01 else v for s, (_, _, v) in state.items()}


def adjusted(rate: Column, x: Column, season: Column, betas: dict[int, float]) -> Column:
    """A rate moved on the logit scale by its season's coefficient; a season without one, or an unknown ``x``, keeps its rate."""
    beta = F.try_element_at(F.create_map(*[e for s, b in betas.items() for e in (F.lit(s), F.lit(float(b)))]), season.cast("int")) if betas else F.lit(0.0)
    return sigmoid(logit(rate) + F.coalesce(beta, F.lit(0.0)) * F.coalesce(x, F.lit(0.0)))
