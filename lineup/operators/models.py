"""Linear models, filters and baselines fitted as Spark aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.operators.order import quantiles


def gram(df: DataFrame, y: str, features: list[str], weight: str | None = None):
    """Weighted means and centred cross products of the features and the target, in one aggregate with few columns."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [*features, y]
    rows = df.dropna(subset=cols)
    agg = [F.sum(w).alias("w")] + [F.sum(w * F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    agg += [F.sum(w * F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    r = rows.agg(*agg).first()
    k, n = len(cols), r["w"] or 0.0
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(k)]) / max(n, 1e-300)
    cross = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) - n * np.outer(mean, mean)
    return n, mean, cross


def ridge_fit(df: DataFrame, y: str, features: list[str], alpha: float = 0.0, weight: str | None = None) -> dict:
    """Weighted ridge on standardised features from the Gram matrix; an exact solution of a small system."""
    n, mean, cross = gram(df, y, features, weight)
    k = len(features)
    scale = np.sqrt(np.maximum(np.diag(cross)[:k] / max(n, 1e-300), 0))
    scale[scale == 0] = 1.0
    a = cross[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    b = cross[:k, k] / scale
    beta = np.linalg.solve(a, b) / scale
    sse = cross[k, k] - 2 * beta @ cross[:k, k] + beta @ cross[:k, :k] @ beta
    return {"features": features, "coef": beta.tolist(), "intercept": float(mean[k] - beta @ mean[:k]), "residual_std": float(np.sqrt(max(sse, 0) / max(n, 1e-300))), "mean": mean[:k].tolist(), "scale": scale.tolist()}


def predict(model: dict) -> Column:
    """The linear prediction as a column."""
    out = F.lit(model["intercept"])
    for f, c in zip(model["features"], model["coef"]):
        out = out + F.col(f) * c
    return out


def contributions(model: dict) -> Column:
    """Each feature's share of the prediction against the mean row, as (feature, value)."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) - m) * c).alias("value")) for f, c, m in zip(model["features"], model["coef"], model["mean"])])


def kalman_filter(observations: Column, q: float, prior_mean: Column, prior_var: float | Column) -> Column:
    """Local-level filter over a time-ordered array of (y, r); a NULL y only predicts. Gives the last (mean, variance)."""
    var = prior_var.cast("double") if isinstance(prior_var, Column) else F.lit(float(prior_var))
    start = F.struct(prior_mean.cast("double").alias("m"), var.alias("v"))

    def step(state, o):
        v = state["v"] + F.lit(float(q))
        gain = v / (v + o["r"])
        seen = F.struct((state["m"] + gain * (o["y"] - state["m"])).alias("m"), ((1 - gain) * v).alias("v"))
        return F.when(o["y"].isNull(), F.struct(state["m"].alias("m"), v.alias("v"))).otherwise(seen)

    return F.aggregate(observations, start, step)


def kalman_smoother(observations: Column, q: float, prior_mean: Column, prior_var: float) -> Column:
    """Filter as above, then the Rauch-Tung-Striebel pass backwards; gives (mean, variance) of every observation."""
    state = "array<struct<m:double,v:double>>"
    start = F.array(F.struct(prior_mean.cast("double").alias("m"), F.lit(float(prior_var)).alias("v"))).cast(state)

    def forward(states, o):
        last = F.element_at(states, -1)
        return F.concat(states, F.array(kalman_filter(F.array(o), q, last["m"], last["v"])))

    def backward(done, s):
        later = F.element_at(done, -1)
        gain = s["v"] / (s["v"] + F.lit(float(q)))
        smooth = F.struct((s["m"] + gain * (later["m"] - s["m"])).alias("m"), (s["v"] + gain * gain * (later["v"] - s["v"] - F.lit(float(q)))).alias("v"))
        return F.concat(done, F.array(smooth))

    filtered = F.reverse(F.aggregate(observations, start, forward))  # the prior is the last one
    rest = F.slice(filtered, 2, F.greatest(F.size(filtered) - 2, F.lit(0)))
    smoothed = F.reverse(F.aggregate(rest, F.slice(filtered, 1, 1), backward))
    return F.when(F.size(observations) > 0, smoothed).when(observations.isNotNull(), F.array().cast(state))


def predict_interval(model: dict, variances: dict[str, Column], z: float) -> tuple[Column, Column, Column]:
    """Prediction, low and high end; residual variance plus the features' own variances through the coefficients."""
    var = F.lit(model["residual_std"] ** 2)
    for f, c in zip(model["features"], model["coef"]):
        if f in variances:
            var = var + c * c * F.greatest(F.coalesce(variances[f].cast("double"), F.lit(0.0)), F.lit(0.0))
    mid, half = predict(model), F.sqrt(var) * z
    return mid, mid - half, mid + half


def interval_scale(df: DataFrame, y: str, p: str, half: str, coverage: float = 0.8) -> DataFrame:
    """The smallest scale of half widths that covers the wished share."""
    return df.where(F.col(half) > 0).transform(lambda d: quantiles(d, [], F.abs(F.col(y) - F.col(p)) / F.col(half), [coverage])).select(F.get("quantiles", F.lit(0)).alias("scale"))


def grid_nll(df: DataFrame, y: str, offset: str, x: str, grid: list[float], ridge: float = 0.25) -> DataFrame:
    """Penalised logistic loss of each coefficient of a grid; rows times grid, one aggregate."""
    betas = F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias("beta")
    p = 1 / (1 + F.exp(-(F.col(offset) + F.col("beta") * F.col(x))))
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = -(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))
    return df.select("*", betas).groupBy("beta").agg((F.sum(loss) + ridge * F.first("beta") * F.first("beta")).alias("nll"))


def fit_offset_beta(df: DataFrame, y: str, offset: str, x: str, low: float = -5.0, high: float = 0.0, ridge: float = 0.25, rounds: int = 8) -> float:
    """The coefficient in [low, high] of least penalised loss: the loss is convex, so each round's grid of 17 closes in on its arg-min by 8."""
    rows = df.dropna(subset=[y, offset, x]).select(F.col(y).cast("double").alias(y), F.col(offset).cast("double").alias(offset), F.col(x).cast("double").alias(x))
    if (rows.agg(F.stddev_pop(x).alias("s")).first()["s"] or 0.0) < 1e-9:
        return 0.0
    a, b, best = low, high, low
    for _ in range(rounds):
        step = (b - a) / 16
        best = grid_nll(rows, y, offset, x, [a + k * step for k in range(17)], ridge).agg(F.min_by("beta", F.struct("nll", F.abs("beta"))).alias("beta")).first()["beta"]
        a, b = max(low, best - step), min(high, best + step)
    return 0.0 if abs(best) < 0.01 else best
