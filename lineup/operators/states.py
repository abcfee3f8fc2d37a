"""State-space models of skills: noise fits, season drift, forecasts, blends and rates. Series are arrays of bounded length (a player's season or career)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions.fit import _or, clip
from lineup.operators.models import kalman_filter, predict, ridge_fit

# Bounds of the process noise and of the persistence, pace of a league without a known one, sequences that a search of one common number takes at most.
NOISE_BOUNDS, RHO_BOUNDS, PACE, SEARCH_SERIES = (1e-6, 100.0), (0.2, 0.95), 68.0, 1000


def series_nll(observations: Column, q: Column, prior_mean: Column, prior_var: Column) -> Column:
    """Negative log likelihood of a series of (y, r) under process noise ``q``, by the filter's one-step predictions."""
    start = F.struct(prior_mean.cast("double").alias("m"), prior_var.cast("double").alias("v"), F.lit(0.0).alias("nll"))

    def step(s, o):
        v = s["v"] + q
        total, error = v + o["r"], o["y"] - s["m"]
        gain = v / total
        seen = F.struct((s["m"] + gain * error).alias("m"), ((1 - gain) * v).alias("v"), (s["nll"] + 0.5 * (F.log(2 * math.pi * total) + error * error / total)).alias("nll"))
        return F.when(o["y"].isNull(), F.struct(s["m"].alias("m"), v.alias("v"), s["nll"].alias("nll"))).otherwise(seen)

    return F.aggregate(observations, start, step)["nll"]


def noise_grid(series: DataFrame, grid: list[float]) -> DataFrame:
    """``q, nll`` of each value of a grid over all series (``o, prior_mean, prior_var``): grid times series, one aggregate.

    Losses of series are added as decimals of nine places, so that the sum does not depend on their order; where one is no such number, as doubles.
    """
    many = series.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in grid])))
    many = many.select("q", series_nll(F.col("o"), F.col("q"), F.col("prior_mean"), F.col("prior_var")).alias("nll"))
    many = many.withColumn("_exact", F.col("nll").try_cast("decimal(28,9)"))
    total = F.when(F.count("nll") == F.count("_exact"), F.sum("_exact").cast("double")).otherwise(F.sum("nll"))
    return many.groupBy("q").agg(total.alias("nll"))


def fit_process_noise(series: DataFrame, key: str, bounds: tuple[float, float] = NOISE_BOUNDS, points: int = 25, rounds: int = 3, most: int = SEARCH_SERIES) -> float:
    """The process noise of least pooled loss: a grid on a log scale, refined around its arg-min. The search takes a hash sample of about
    ``most`` series, as one common number does not need all; the sample does not depend on partitions."""
    n = series.count()
    share = min(1.0, most / max(1, n))
    some = series.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).cache()
    low, high = math.log(bounds[0]), math.log(bounds[1])
    best = low
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = {math.exp(low + k * step): low + k * step for k in range(points)}
        q = noise_grid(some, list(grid)).agg(F.min_by("q", F.struct("nll", "q")).alias("q")).first()["q"]
        best = grid.get(q, math.log(q) if q else low)
        low, high = max(low, best - step), min(high, best + step)
    some.unpersist()
    return math.exp(best)


def drift_filter(observations: Column, rho: float, q: float, prior_mean: Column, prior_var: Column) -> Column:
    """Season filter ``a' = rho a + mu`` over an ordered array of (season, y, r, mu): array of (season, mean, var, residual), residuals
    standardised; a NULL ``y`` predicts only and has no residual."""
    row = "array<struct<season:bigint,mean:double,var:double,residual:double>>"
    start = F.struct(prior_mean.cast("double").alias("m"), prior_var.cast("double").alias("v"), F.array().cast(row).alias("rows"))

    def step(s, o):
        m, v = rho * s["m"] + o["mu"], rho * rho * s["v"] + F.lit(float(q))
        gain = F.when(o["y"].isNull(), 0.0).otherwise(v / (v + o["r"]))
        mean, var = m + gain * (F.coalesce(o["y"], m) - m), (1 - gain) * v
        out = F.struct(o["season"].cast("bigint").alias("season"), mean.alias("mean"), var.alias("var"), ((o["y"] - m) / F.sqrt(v + o["r"])).alias("residual"))
        return F.struct(mean.alias("m"), var.alias("v"), F.concat(s["rows"], F.array(out)).alias("rows"))

    return F.aggregate(observations, start, step)["rows"]


def drift(betas: tuple[float, ...], x: Column, moved: Column, tier_change: Column) -> Column:
    """The season's expected change from career index, move and tier change."""
    b = [float(v) for v in betas]
    return b[0] + b[1] * x + b[2] * x * x + b[3] * moved + b[4] * tier_change


def persistence(df: DataFrame, key: str, season: str, y: str, least: int = 50) -> float | None:
    """Lag-one correlation of a key's consecutive rows, held within bounds; None with fewer than ``least`` pairs."""
    w = Window.partitionBy(key).orderBy(season)
    r = df.withColumn("_next", F.lead(y).over(w)).where(F.col("_next").isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(y, "_next").alias("r")).first()
    if r["n"] < least or r["r"] is None or math.isnan(r["r"]):
        return None
    return min(max(r["r"], RHO_BOUNDS[0]), RHO_BOUNDS[1])


def fit_drift(df: DataFrame, key: str, season: str, y: str, r: str, covariates: tuple[str, str, str], rounds: int = 3) -> dict:
    """Persistence, the drift's coefficients by least squares on ``y' - rho a`` (``a``: filtered states under the last coefficients) and the noise from its residuals."""
    rho = persistence(df, key, season, y)
    rho = 0.8 if rho is None else rho
    x, moved, tier = covariates
    prior = df.agg(F.avg(y).alias("m"), F.coalesce(F.nullif(F.var_samp(y), F.lit(0.0)) * 4, F.lit(1.0)).alias("v")).first()
    betas, q = (0.0,) * 5, max(prior["v"] / 40, 1e-4)
    for _ in range(rounds):
        rows = season_states(df, key, season, y, r, covariates, rho, betas, q, (prior["m"], prior["v"]))
        w = Window.partitionBy(key).orderBy(season)
        rows = rows.withColumns({"_a": F.lag("mean").over(w), "_x2": F.col(x) * F.col(x)}).where(F.col("_a").isNotNull()).withColumn("_d", F.col(y) - rho * F.col("_a"))
        m = ridge_fit(rows, "_d", [x, "_x2", moved, tier], alpha=1e-6)
        betas = (m["intercept"], *m["coef"])
        noise = rows.agg(F.avg(r).alias("r")).first()["r"] or 0.0
        q = max(m["residual_std"] ** 2 - noise, 1e-4)
    return {"rho": rho, "betas": betas, "q": q, "prior": (prior["m"], prior["v"])}


def season_states(df: DataFrame, key: str, season: str, y: str, r: str, covariates: tuple[str, str, str], rho: float, betas: tuple[float, ...], q: float, prior: tuple[float, float]) -> DataFrame:
    """The rows of ``df`` with ``mean, var, residual`` of the season filter."""
    mu = drift(betas, *[F.col(c) for c in covariates])
    o = F.array_sort(F.collect_list(F.struct(F.col(season).alias("season"), F.col(y).cast("double").alias("y"), F.greatest(F.col(r).cast("double"), F.lit(1e-6)).alias("r"), mu.alias("mu"))))
    states = df.groupBy(key).agg(o.alias("_o")).select(key, F.explode(drift_filter(F.col("_o"), rho, q, F.lit(prior[0]), F.lit(prior[1]))).alias("_s"))
    return df.join(states.select(key, F.col("_s.season").alias(season), "_s.mean", "_s.var", "_s.residual"), [key, season])


def forecast_next(states: DataFrame, covariates: DataFrame, key: str, season: str, names: tuple[str, str, str], rho: float, betas: tuple[float, ...], q: float) -> DataFrame:
    """Each state one season on: mean and variance with the target season's covariates; without any the career goes on by one and nothing else changes."""
    x, moved, tier = names
    own = covariates.select(key, season, F.col(x).alias("_x0"))
    target = covariates.select(key, (F.col(season) - 1).alias(season), F.col(x).alias("_x"), F.col(moved).alias("_moved"), F.col(tier).alias("_tier"))
    s = states.join(own, [key, season], "left").join(target, [key, season], "left")
    mu = drift(betas, F.coalesce("_x", F.col("_x0") + 1), _or(F.col("_moved"), 0), _or(F.col("_tier"), 0))
    return s.select(key, F.col(season).alias("source_season"), (F.col(season) + 1).alias(season), (rho * F.col("mean") + mu).alias("mean"), (rho * rho * F.greatest("var", F.lit(0.0)) + q).alias("var"))


def blend_blocks(df: DataFrame, skills: list[str]) -> DataFrame:
    """Each skill moved by its most correlated block mate's residual: ``<skill>_blended``. Columns: ``<skill>``, ``<skill>_var``, ``<skill>_residual``."""
    pairs = [(a, b) for k, a in enumerate(skills) for b in skills[k + 1 :]]
    r = df.agg(*[F.corr(f"{a}_residual", f"{b}_residual").alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    value = {frozenset(p): r[f"{p[0]}|{p[1]}"] or 0.0 for p in pairs}
    for s in skills:
        mates = [m for m in skills if m != s]
        if mates:
            best = max(mates, key=lambda m: abs(value[frozenset((s, m))]))
            df = df.withColumn(f"{s}_blended", F.col(s) + value[frozenset((s, best))] * F.col(f"{best}_residual") * F.sqrt(F.greatest(f"{s}_var", F.lit(0.0))))
    return df


def project_rates(df: DataFrame, models: dict[str, dict], shooting: dict[str, str], direct: dict[str, str], pace: str | None = None) -> DataFrame:
    """Attempts from linear models (at least 0), made and missed by the shooting skill, rates read off skills, each also per 100 possessions."""
    out = {name: F.greatest(predict(m), F.lit(0.0)) for name, m in models.items()}
    for name, skill in shooting.items():
        pct = clip(F.col(skill), 0.0, 1.0)
        out |= {f"{name}_make": out[name] * pct, f"{name}_miss": out[name] * (1 - pct)}
    out |= {name: F.greatest(F.col(skill), F.lit(0.0)) for name, skill in direct.items()}
    p = F.lit(PACE) if pace is None else F.when(F.col(pace) > 0, F.col(pace)).otherwise(PACE)
    return df.withColumns(out | {f"{n}_per100": c / (p / 100) for n, c in out.items()})


def filtered(observations: Column, q: float, prior_mean: Column, prior_var: float) -> Column:
    """The last (mean, variance) of a series, under a fitted noise."""
    return kalman_filter(observations, q, prior_mean, prior_var)
