"""Aggregations over groups: shares, means, metrics, shrinkage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators.order import few_rows, join_keys, quantiles


def _by(keys) -> list:
    return [keys] if isinstance(keys, str) else list(keys)


def shot_profile(df: DataFrame, key, label: str, labels: list[str]) -> DataFrame:
    """Count and share of each class per key."""
    counts = [F.count_if(F.col(label) == v).alias(f"n_{v}") for v in labels]
    shares = [(F.count_if(F.col(label) == v) / F.count("*")).alias(f"share_{v}") for v in labels]
    return df.groupBy(*_by(key)).agg(F.count("*").alias("n"), *counts, *shares)


def weighted_mean(df: DataFrame, key, value: str, weight: str, out: str = "mean") -> DataFrame:
    """Weighted mean, the plain mean where weights add up to 0."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*_by(key)).agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(value)).alias(out))


def mode_by(df: DataFrame, key, value: str, out: str = "mode") -> DataFrame:
    """The most frequent value per key, ties to the smaller value."""
    counts = df.groupBy(*_by(key), value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*_by(key)).orderBy(F.desc("n"), value)
    return counts.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*_by(key), F.col(value).alias(out), "n")


def hhi(df: DataFrame, key, value: str, out: str = "hhi") -> DataFrame:
    """Concentration, the sum of squared shares."""
    return df.groupBy(*_by(key)).agg((F.sum(F.col(value) * F.col(value)) / F.nullif(F.sum(value) * F.sum(value), F.lit(0.0))).alias(out))


def benchmark(df: DataFrame, key, features: list[str], weight: str | None = None) -> DataFrame:
    """(weighted) means of a feature list per key."""
    if weight is None:
        return df.groupBy(*_by(key)).agg(*[F.avg(f).alias(f) for f in features])
    return df.groupBy(*_by(key)).agg(*[(F.sum(F.col(f) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias(f) for f in features])


def gap(own: DataFrame, league: DataFrame, key, features: list[str]) -> DataFrame:
    """How far an entity's means fall short of the league's, per key."""
    theirs = league.select(*_by(key), *[F.col(f).alias(f"_{f}") for f in features])
    return own.join(theirs, _by(key), "left").withColumns({f"gap_{f}": F.greatest(F.lit(0.0), F.col(f"_{f}") - F.col(f)) for f in features}).drop(*[f"_{f}" for f in features])


def value_counts_map(df: DataFrame, key, label: str, out: str = "counts", prefix: str = "") -> DataFrame:
    """Counts per label as a map."""
    counts = df.groupBy(*_by(key), label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*_by(key)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(prefix), F.col(label)), "_n")))).alias(out))


def median_impute(df: DataFrame, group, features: list[str]) -> DataFrame:
    """Missing values become the group's median, else the overall median, else 0; counts what was missing."""
    g = _by(group)
    gone = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    holes = [f for f in features if gone[f]]
    out = df
    if holes:
        pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in holes)
        long = df.selectExpr(*[f"`{k}`" for k in g], f"stack({len(holes)}, {pairs}) as (_f, _v)")
        middle = lambda keys: quantiles(long, [*keys, "_f"], F.col("_v"), [0.5], "_q").withColumn("_q", F.get("_q", F.lit(0)))
        wide = lambda keys, p: middle(keys).groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == f, F.col("_q"))).alias(f"{p}{f}") for f in holes])
        # rows are not shuffled by the group, of which there may be a handful
        out = join_keys(join_keys(df, few_rows(wide(g, "_g_")), g, "left"), few_rows(wide([], "_o_")), [])
    missing = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in features])
    out = out.withColumn("missing_count", missing)
    filled = {f: F.coalesce(f, f"_g_{f}", f"_o_{f}", F.lit(0.0)) if f in holes else F.col(f).cast("double") for f in features}
    return out.withColumns(filled).select(*df.columns, "missing_count")


def hierarchical_mean_prior(df: DataFrame, value: str, *levels, out: str = "prior") -> DataFrame:
    """Mean of the finest level (a list of keys, none for all rows) that has one; the means are small tables that are joined back."""
    for k, level in enumerate(levels):
        keys = _by(level) if level else []
        df = join_keys(df, df.groupBy(*keys).agg(F.avg(value).alias(f"_level{k}")), keys, "left" if keys else "inner")
    names = [f"_level{k}" for k in range(len(levels))]
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def eb_shrink(df: DataFrame, value: str, weight: str, k: float, *levels, out: str = "shrunk") -> DataFrame:
    """The raw value drawn to its hierarchical prior by its weight; level means are joined, so no task holds all rows."""
    src = df
    for n, level in enumerate(levels):
        means = df.groupBy(*_by(level)).agg(F.avg(value).alias(f"_p{n}")) if level else df.agg(F.avg(value).alias(f"_p{n}"))
        src = src.join(means, _by(level), "left") if level else src.crossJoin(F.broadcast(means))
    prior = F.coalesce(*[F.col(f"_p{n}") for n in range(len(levels))])
    w = F.col(weight)
    src = src.withColumn(out, prior + w / (w + k) * (F.coalesce(F.col(value), prior) - prior))
    return src.select(*df.columns, out)


def decayed_rates(df: DataFrame, success: str, season: str, now: int, levels: list[list[str]], decay: float = 0.9) -> DataFrame:
    """Recency-weighted success rate and effective count at every level, in one pass of grouping sets."""
    cols = list(dict.fromkeys(c for level in levels for c in level))
    weighted = df.where(F.col(success).isNotNull() & (F.col(season) < now)).withColumn("_w", F.pow(F.lit(decay), F.lit(now) - F.col(season)))
    sets = [[F.col(c) for c in level] for level in levels]
    return weighted.groupingSets(sets, *cols).agg(F.sum("_w").alias("n_eff"), (F.sum(F.col("_w") * F.col(success)) / F.sum("_w")).alias("rate"), F.grouping_id().alias("level"))


def shrink_chain(rate_n: list[tuple[Column, Column]], k: float) -> Column:
    """Cell to pair to cluster to overall: each level is drawn to the one above; ``rate_n`` from coarse to fine."""
    out = rate_n[0][0]
    for rate, n in rate_n[1:]:
        n = F.coalesce(n, F.lit(0.0))
        out = (n * F.coalesce(rate, out) + k * out) / (n + k)
    return out


def regression_metrics(df: DataFrame, y: str, p: str, *keys: str) -> DataFrame:
    """Count, MAE, RMSE, bias, R2."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_e", F.col(p) - F.col(y))
    sse = F.sum(F.col("_e") * F.col("_e"))
    agg = [F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("bias"), (1 - sse / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2")]
    return d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)


def interval_coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    """Share of truths inside the interval, and its mean width."""
    return df.agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"))


def tail_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Rates, precision and recall at a threshold."""
    a, b = F.col(y) >= threshold, F.col(p) >= threshold
    both = F.count_if(a & b)
    return df.agg(F.avg(a.cast("double")).alias("actual_rate"), F.avg(b.cast("double")).alias("predicted_rate"), (both / F.nullif(F.count_if(b), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if(a), F.lit(0))).alias("recall"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean squared error of a probability."""
    return df.agg(F.count("*").alias("n"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def calibration(df: DataFrame, y: str, p: str, tier: str, tiers: list[int]) -> DataFrame:
    """Count, mean prediction, actual rate and gap per ordered tier; empty tiers stay."""
    grid = df.sparkSession.createDataFrame([(t,) for t in tiers], f"{tier} int")
    got = df.groupBy(F.col(tier).cast("int").alias(tier)).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual"))
    return F.broadcast(grid).join(got, tier, "left").select(tier, F.coalesce("n", F.lit(0)).alias("n"), "predicted", "actual", (F.col("predicted") - F.col("actual")).alias("gap"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over quantile bins; edges that coincide merge."""
    edges = quantiles(df, [], F.col(p), [k / bins for k in range(1, bins)], "_edges").withColumn("_edges", F.array_distinct("_edges"))
    b = df.crossJoin(F.broadcast(edges)).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    per = b.groupBy("_bin").agg(F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    return per.agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"))


def distribution_tvd(a: DataFrame, b: DataFrame, value: str, width: float) -> DataFrame:
    """Half the L1 distance of two histograms."""
    tagged = a.select(F.floor(F.col(value) / width).alias("_b"), F.lit(1).alias("_a")).unionByName(b.select(F.floor(F.col(value) / width).alias("_b"), F.lit(0).alias("_a")))
    per = tagged.groupBy("_b").agg(F.sum("_a").alias("_x"), F.sum(1 - F.col("_a")).alias("_y"))
    total = per.agg(F.sum("_x").alias("_tx"), F.sum("_y").alias("_ty"))
    return per.crossJoin(F.broadcast(total)).agg((F.sum(F.abs(F.col("_x") / F.col("_tx") - F.col("_y") / F.col("_ty"))) / 2).alias("tvd"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null share and five-number summary of each column, in long form."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (feature, value)")
    stats = long.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("low"), F.max("value").alias("high"))
    q = quantiles(long, "feature", F.col("value"), [0.25, 0.5, 0.75])
    at = lambda k: F.get("quantiles", F.lit(k))
    return stats.join(q, "feature", "left").select("feature", "n", "nulls", "low", at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"), "high")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, one aggregate for all pairs."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def reconcile(detail: DataFrame, summary: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Sums of detail rows against a summary table, per field: match rate and total absolute difference."""
    sums = detail.groupBy(key).agg(*[F.sum(d).alias(f"_{d}") for d in fields])
    both = summary.join(sums, key)
    per = [F.struct(F.lit(s).alias("field"), F.avg((F.abs(F.col(s) - F.col(f"_{d}")) < 0.005).cast("double")).alias("match_rate"), F.sum(F.abs(F.col(s) - F.col(f"_{d}"))).alias("total_delta")) for d, s in fields.items()]
    return both.agg(F.array(*per).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def career_summary(df: DataFrame, key: str, season: str, team: str) -> DataFrame:
    """Seasons, teams, first and last season per id."""
    return df.groupBy(key).agg(F.countDistinct(season).alias("seasons"), F.countDistinct(team).alias("teams"), F.min(season).alias("first_season"), F.max(season).alias("last_season"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list, value: str) -> DataFrame:
    """Cross-tab of means, with the columns listed so that no extra job finds them."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(value))


def status_report(df: DataFrame, status: str) -> DataFrame:
    """Count and share by status."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(status, "n", (F.col("n") / F.col("_t")).alias("share"))
