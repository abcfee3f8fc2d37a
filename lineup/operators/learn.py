"""Clusterings, principal components, boosting and intervals fitted on Spark."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.functions.fit import _or, clip
from lineup.operators.models import gram, predict, ridge_fit
from lineup.operators.order import join_keys, quantiles

# What a confidence on the first dimensions only is worth; parts of a weighting's score; a role's shares of minutes and usage.
FALLBACK, SCORE_PARTS = 0.75, {"silhouette": 0.35, "separation": 0.20, "balance": 0.20, "focus": 0.25}
ROLE_AT, HIGH_USAGE, MOST_SHARE, GAIN = {"rotation": 0.30, "starter": 0.60, "heavy": 0.80}, 26.0, 0.95, 0.02


def _add(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def scale_stats(df: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and population deviations (1 where there is no spread) of columns, in one aggregate."""
    r = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    return {c: r[f"m{k}"] or 0.0 for k, c in enumerate(columns)}, {c: r[f"s{k}"] or 1.0 for k, c in enumerate(columns)}


def group_scale(df: DataFrame, groups: dict[str, list[str]], weights: dict[str, float], covered: str | None = None, only_covered: tuple[str, ...] = ()) -> list[Column]:
    """Columns ``z_<c>``: z-scores times the root of the group's weight over its size. Groups in ``only_covered`` are measured on covered rows."""
    out = []
    for g, columns in groups.items():
        mean, sd = scale_stats(df.where(F.col(covered)) if covered and g in only_covered else df, columns)
        factor = (weights[g] / len(columns)) ** 0.5
        out += [((F.col(c) - mean[c]) / sd[c] * factor).alias(f"z_{c}") for c in columns]
    return out


def fit_centres(df: DataFrame, columns: list[str], k: int, seed: int = 42, rounds: int = 40) -> np.ndarray:
    """Centres of a k-means clustering; the rows stay distributed, ``k`` centres come to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.select(*columns)).select("_v")
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v").fit(vectors)
    return np.array([c for c in model.clusterCenters()])


def relabel(centres: np.ndarray, columns: list[str], signatures: list[tuple[int, dict[str, float]]]) -> np.ndarray:
    """Centres in the order of fixed slots: signatures (slot, weights of centre z-scores) pick in turn the best centre that is left; the last slot takes what remains."""
    sd = centres.std(axis=0)
    z = (centres - centres.mean(axis=0)) / np.where(sd == 0, 1.0, sd)
    left, out = list(range(len(centres))), np.empty_like(centres)
    slots = [s for s, _ in signatures]
    for slot, weights in signatures:
        best = max(left, key=lambda i: (sum(w * z[i, columns.index(c)] for c, w in weights.items()), -i))
        out[slot] = centres[best]
        left.remove(best)
    for slot, i in zip([s for s in range(len(centres)) if s not in slots], left):
        out[slot] = centres[i]
    return out


def distances(columns: list[str], centres: np.ndarray) -> Column:
    """Euclidean distances of a row to each centre, on as many dimensions as there are columns."""
    return F.array(*[F.sqrt(_add([(F.col(c) - float(v)) ** 2 for c, v in zip(columns, row)])) for row in centres])


def assign(df: DataFrame, columns: list[str], centres: np.ndarray, covered: Column | None = None, prefix: int | None = None) -> DataFrame:
    """``cluster, confidence`` (1 - nearest / second). Rows that are not covered are placed by the first ``prefix`` dimensions, at a discount."""
    full = distances(columns, centres)
    d = full if covered is None else F.when(covered, full).otherwise(distances(columns[:prefix], centres[:, :prefix]))
    sure = F.lit(1.0) if covered is None else F.when(covered, 1.0).otherwise(FALLBACK)
    df = df.withColumn("_d", d).withColumn("_s", F.array_sort("_d"))
    near = F.array_position("_d", F.get("_s", F.lit(0))).cast("int") - 1
    confidence = F.when(F.get("_s", F.lit(1)) > 0, 1 - F.get("_s", F.lit(0)) / F.get("_s", F.lit(1))).otherwise(0.0) * sure
    return df.withColumns({"cluster": near, "confidence": confidence}).drop("_d", "_s")


def two_layer_clusters(df: DataFrame, offense: tuple[list[str], np.ndarray], defense: tuple[list[str], np.ndarray], covered: Column, labels: tuple[list[str], list[str]]) -> DataFrame:
    """Independent clusters of offence and defence and their joint label; rows without defence data have an offence only."""
    out = assign(df, *offense).withColumnsRenamed({"cluster": "offense", "confidence": "offense_confidence"})
    out = assign(out, *defense).withColumnsRenamed({"cluster": "defense", "confidence": "defense_confidence"})
    out = out.withColumns({"defense": F.when(covered, F.col("defense")), "defense_confidence": F.when(covered, F.col("defense_confidence"))})
    name = lambda at, names: F.get(F.array(*[F.lit(n) for n in names]), F.col(at))
    return out.withColumn("system", F.concat_ws(" / ", name("offense", labels[0]), F.coalesce(name("defense", labels[1]), F.lit("defense not known"))))


def cluster_quality(df: DataFrame, columns: list[str], centres: np.ndarray) -> dict:
    """Silhouette (of squared distances, from the clusters' sums), separation (Davies-Bouldin), inertia and cluster shares: one pass over the rows."""
    k = len(centres)
    d2 = F.array(*[_add([(F.col(c) - float(v)) ** 2 for c, v in zip(columns, row)]) for row in centres])
    rows = df.select(*columns, d2.alias("_d")).withColumn("_c", F.array_position("_d", F.array_min("_d")).cast("int") - 1)
    stats = {r["_c"]: r for r in rows.groupBy("_c").agg(F.count("*").alias("n"), F.avg(F.sqrt(F.array_min("_d"))).alias("spread"), F.sum(F.array_min("_d")).alias("inertia"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], F.sum(_add([F.col(c) * F.col(c) for c in columns])).alias("sq")).collect()}
    total = sum(r["n"] for r in stats.values())
    # mean squared distance of a row to a cluster: |x|^2 - 2 x mean + mean of |y|^2
    own = F.lit(0.0)
    norm = _add([F.col(c) * F.col(c) for c in columns])
    mean2 = {c: norm - 2 * _add([F.col(x) * float(r[f"m{i}"]) for i, x in enumerate(columns)]) + r["sq"] / r["n"] for c, r in stats.items()}
    a, b = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c, r in stats.items():
        own = F.when(F.col("_c") == c, mean2[c] * (r["n"] / max(1, r["n"] - 1))).otherwise(own)
        others = [mean2[o] for o in stats if o != c]
        b = F.when(F.col("_c") == c, F.least(*others) if len(others) > 1 else others[0] if others else F.lit(None)).otherwise(b)
    a = own
    silhouette = rows.agg(F.avg(F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)).alias("s")).first()["s"] or 0.0
    db = []
    for i in stats:
        ratios = [(stats[i]["spread"] + stats[j]["spread"]) / max(1e-12, float(np.linalg.norm(centres[i] - centres[j]))) for j in stats if j != i]
        db.append(max(ratios, default=0.0))
    shares = [stats[c]["n"] / total if c in stats else 0.0 for c in range(k)]
    apart = min((float(np.linalg.norm(centres[i] - centres[j])) for i in range(k) for j in range(i)), default=0.0)
    return {"k": k, "silhouette": float(silhouette), "davies_bouldin": float(np.mean(db)) if db else 0.0, "inertia": float(sum(r["inertia"] for r in stats.values())), "separation": apart, "least_share": min(shares), "most_share": max(shares)}


def _sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    n = df.count()
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << 20)) < int(min(1.0, rows / max(1, n)) * (1 << 20)))


def k_sweep(df: DataFrame, key: str, columns: list[str], ks: list[int], sample: int = 20_000, seed: int = 42) -> DataFrame:
    """Quality measures for each number of clusters, on a hash sample of about ``sample`` rows."""
    some = _sample(df, key, sample).select(*columns).cache()
    out = [cluster_quality(some, columns, fit_centres(some, columns, k, seed)) for k in ks]
    some.unpersist()
    names = ("k", "inertia", "silhouette", "separation", "least_share")
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in out], "k int, inertia double, silhouette double, separation double, least_share double")


def weight_search(df: DataFrame, key: str, groups: dict[str, list[str]], start: dict[str, float], k: int, trials: int = 12, focus: str | None = None, sample: int = 20_000, seed: int = 42) -> tuple[dict[str, float], list[dict]]:
    """Jittered group weights, each clustered on one hash sample and scored by silhouette, separation, balance of sizes and how far the
    cluster means of the ``focus`` group stand out; the parts are put on 0-1 over the trials and weighed. Gives the best weights and all trials."""
    rng = np.random.default_rng(seed)
    some, columns = _sample(df, key, sample).cache(), [c for g in groups.values() for c in g]
    out = []
    for t in range(trials):
        raw = {g: w * float(np.exp(rng.normal(0, 0.28))) if t else w for g, w in start.items()}
        w = {g: v / sum(raw.values()) for g, v in raw.items()}
        scaled = some.select(*group_scale(some, groups, w))
        names = [f"z_{c}" for c in columns]
        centres = fit_centres(scaled, names, k, seed)
        q = cluster_quality(scaled, names, centres)
        own = [columns.index(c) for c in groups.get(focus, [])]
        size = (w[focus] / len(own)) ** 0.5 if own else 1.0
        q["focus"] = float(np.clip(np.abs(centres[:, own] / size).mean(axis=1).max() / 1.25, 0, 1)) if own else 0.0
        q["balance"] = min(q["least_share"] / 0.05, 1.0) * min(0.24 / max(q["most_share"], 1e-9), 1.0)
        out.append(q | {"weights": w})
    some.unpersist()

    def unit(name: str, sign: int) -> list[float]:
        v = [sign * r[name] for r in out]
        return [1.0 if max(v) - min(v) < 1e-12 else (x - min(v)) / (max(v) - min(v)) for x in v]

    for r, s, d in zip(out, unit("silhouette", 1), unit("davies_bouldin", -1)):
        r["score"] = SCORE_PARTS["silhouette"] * s + SCORE_PARTS["separation"] * d + SCORE_PARTS["balance"] * r["balance"] + SCORE_PARTS["focus"] * r["focus"]
    return max(out, key=lambda r: r["score"])["weights"], out


def pca(df: DataFrame, columns: list[str], k: int) -> dict:
    """Components of the standardised columns from their correlation matrix (one aggregate), largest variance first; each component's largest loading is positive."""
    n, mean, cross = gram(df, columns[0], columns[1:])
    order = [len(columns) - 1, *range(len(columns) - 1)]  # the target of the Gram matrix comes last
    cross, mean = cross[np.ix_(order, order)] / max(n, 1e-300), mean[order]
    sd = np.sqrt(np.diag(cross))
    sd[sd == 0] = 1.0
    value, vector = np.linalg.eigh(cross / np.outer(sd, sd))
    value, vector = value[::-1], vector[:, ::-1]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), range(len(columns))])
    return {"columns": columns, "mean": mean.tolist(), "scale": sd.tolist(), "explained": (value / value.sum())[:k].tolist(), "components": vector[:, :k].T.tolist()}


def pca_columns(model: dict) -> list[Column]:
    """``pc1``, ``pc2``, ... of a fitted model."""
    z = [(F.col(c) - m) / s for c, m, s in zip(model["columns"], model["mean"], model["scale"])]
    return [_add([x * float(w) for x, w in zip(z, row)]).alias(f"pc{k + 1}") for k, row in enumerate(model["components"])]


def staged_boosting(train: DataFrame, features: list[str], share: str, usage: str, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Classifiers of rotation, starter, heavy minutes and high usage feed two regressors, which weigh starters and heavy users more.

    Gives a function of a frame: ``p_rotation, p_starter, p_heavy`` (each at most the one before), ``p_usage, expected_share, expected_usage``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    targets = {f"p_{n}": (F.col(share) >= at).cast("double") for n, at in ROLE_AT.items()} | {"p_usage": (F.col(usage) >= HIGH_USAGE).cast("double")}
    base = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    filled = lambda df: df.withColumns({c: _or(F.col(c), 0) for c in features})
    # the features are kept once, as vectors
    rows = base.transform(filled(train).withColumns({f"_y_{n}": y for n, y in targets.items()})).select("_x", share, usage, *[f"_y_{n}" for n in targets]).cache()
    rates = rows.agg(*[F.avg(f"_y_{n}").alias(n) for n in targets]).first()
    models = {n: GBTClassifier(featuresCol="_x", labelCol=f"_y_{n}", maxIter=rounds, maxDepth=depth, seed=seed + k).fit(rows) if 0 < (rates[n] or 0) < 1 else None for k, n in enumerate(targets)}
    stage = VectorAssembler(inputCols=["_x", *targets], outputCol="_z", handleInvalid="keep")

    def with_roles(df: DataFrame) -> DataFrame:
        for n, m in models.items():
            if m is None:
                df = df.withColumn(n, F.lit(float(rates[n] or 0)))
            else:
                m = m.copy().setProbabilityCol(f"_q_{n}").setRawPredictionCol(f"_r_{n}").setPredictionCol(f"_c_{n}")
                df = m.transform(df).withColumn(n, F.get(vector_to_array(f"_q_{n}"), F.lit(1))).drop(f"_q_{n}", f"_r_{n}", f"_c_{n}")
        held = df.withColumn("p_starter", F.least("p_starter", "p_rotation"))
        return stage.transform(held.withColumn("p_heavy", F.least("p_heavy", "p_starter")))

    weighted = with_roles(rows).withColumns({"_wm": 1 + 0.35 * F.col("_y_p_starter") + 0.70 * F.col("_y_p_heavy"), "_wu": 1 + 0.50 * F.col("_y_p_usage")}).select("_z", share, usage, "_wm", "_wu").cache()
    weighted.count()  # from here on the classifiers are not asked again
    rows.unpersist()
    fit = lambda y, w, s: GBTRegressor(featuresCol="_z", labelCol=y, weightCol=w, maxIter=rounds, maxDepth=depth, seed=s).fit(weighted)
    minutes, use = fit(share, "_wm", seed), fit(usage, "_wu", seed + 1)
    weighted.unpersist()

    def run(df: DataFrame) -> DataFrame:
        out = minutes.copy().setPredictionCol("_s").transform(with_roles(base.transform(filled(df))))
        out = use.copy().setPredictionCol("_u").transform(out)
        return out.withColumns({"expected_share": clip(F.col("_s"), 0.0, MOST_SHARE), "expected_usage": clip(F.col("_u"), 0.0, 100.0)}).drop("_x", "_z", "_s", "_u")

    return run


def conformal_interval(held: DataFrame, df: DataFrame, y: str, p: str, bucket: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``low, high`` around each prediction from the residual percentiles of held-out rows of its bucket (split conformal); a bucket that was not held out takes those of all."""
    e = F.col(y) - F.col(p)
    own, every = quantiles(held, bucket, e, [low, high], "_q"), quantiles(held, [], e, [low, high], "_all")
    out = join_keys(join_keys(df, own, bucket, "left"), every, [])
    at = lambda k: F.get(F.coalesce("_q", "_all"), F.lit(k))
    return out.withColumns({"low": F.least(F.col(p) + at(0), F.col(p)), "high": F.greatest(F.col(p) + at(1), F.col(p))}).drop("_q", "_all")


def gated_weights(train: DataFrame, test: DataFrame, y: str, base: list[str], more: list[str], defaults: dict[str, float], alpha: float = 0.0, gain: float = GAIN) -> dict:
    """Weights of ``more`` refitted beside ``base``, taken only if the held-out residual deviation falls by ``gain`` or more, else the defaults."""
    std = lambda m: test.agg(F.stddev_pop(F.col(y) - predict(m)).alias("s")).first()["s"] or 0.0
    small_, large = ridge_fit(train, y, base, alpha), ridge_fit(train, y, [*base, *more], alpha)
    a, b = std(small_), std(large)
    better = a > 0 and (a - b) / a >= gain
    fitted = dict(zip(large["features"], large["coef"]))
    return {"accepted": bool(better), "base_std": a, "more_std": b, "weights": {c: fitted[c] if better else defaults[c] for c in more}}


def residual_clusters(df: DataFrame, key: str, residuals: list[str], ks: list[int], cohort: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Standardised residual vectors clustered with the k whose inertia falls most sharply; mean residuals of each cluster, and each cohort's bias in it."""
    mean, sd = scale_stats(df, residuals)
    z = df.select(key, cohort, *residuals, *[((F.col(c) - mean[c]) / sd[c]).alias(f"z_{c}") for c in residuals]).dropna(subset=residuals).cache()
    names = [f"z_{c}" for c in residuals]
    fits = {k: fit_centres(z, names, k, seed) for k in ks}
    cost = {k: cluster_quality(z, names, c)["inertia"] for k, c in fits.items()}
    falls = {k: (cost[ks[i - 1]] - cost[k]) - (cost[k] - cost[ks[i + 1]]) for i, k in enumerate(ks) if 0 < i < len(ks) - 1}
    best = max(falls, key=falls.get) if falls else ks[0]
    placed = assign(z, names, fits[best])
    profile = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in residuals])
    bias = placed.groupBy("cluster", cohort).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in residuals])
    return profile, bias
