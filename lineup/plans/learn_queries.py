"""Clustering, component, boosting and interval queries; what is seeded has no SQL and is compared by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import learn as T
from lineup.plans.aggregate_queries import _PRED, predictions
from lineup.plans.base import Registry, r6, table

R = Registry()
_V = [f"v{k}" for k in range(8)]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(_V)])


_FACTOR = {"a": (["v0", "v1", "v2"], 0.6), "b": (["v3", "v4"], 0.4)}


@R("M01_group_scale", f"""WITH v AS (SELECT vec_id, label % 2 = 0 AS covered, {', '.join(f'embedding[{k + 1}]::DOUBLE AS v{k}' for k in range(5))} FROM embeddings),
s AS (SELECT {', '.join(f"avg({c}) {'FILTER (covered)' if g == 'b' else ''} AS m_{c}, stddev_pop({c}) {'FILTER (covered)' if g == 'b' else ''} AS s_{c}" for g, (cs, _) in _FACTOR.items() for c in cs)} FROM v)
SELECT vec_id, {', '.join(f'round(({c} - m_{c}) / s_{c} * sqrt({w} / {len(cs)}), 6) AS z_{c}' for cs, w in _FACTOR.values() for c in cs)} FROM v, s""")
def m01(spark, d):
    rows = _vectors(spark, d).withColumn("covered", F.col("label") % 2 == 0)
    z = T.group_scale(rows, {g: cs for g, (cs, _) in _FACTOR.items()}, {g: w for g, (_, w) in _FACTOR.items()}, "covered", ("b",))
    return rows.select("vec_id", *z).select("vec_id", *[r6(f"z_{c}") for cs, _ in _FACTOR.values() for c in cs])


@R("M02_kmeans_semantic")
def m02(spark, d):
    """Six clusters on covered rows in the order of their signatures; the others are placed by their first five dimensions."""
    rows = _vectors(spark, d).withColumn("covered", F.col("label") < 7)
    centres = T.fit_centres(rows.where("covered"), _V, 6)
    centres = T.relabel(centres, _V, [(2, {"v0": 1.0}), (0, {"v1": 1.0, "v2": -1.0}), (1, {"v3": -1.0})])
    return T.assign(rows, _V, centres, F.col("covered"), 5).select("vec_id", "cluster", r6("confidence"))


@R("M03_two_layer_clusters")
def m03(spark, d):
    rows = _vectors(spark, d)
    off, deff = _V[:4], _V[4:]
    got = T.two_layer_clusters(rows, (off, T.fit_centres(rows, off, 3)), (deff, T.fit_centres(rows, deff, 2)), F.col("label") != 0, (["fast", "slow", "mixed"], ["press", "zone"]))
    return got.select("vec_id", "offense", "defense", "system")


@R("M04_weight_search")
def m04(spark, d):
    """Five weightings of two groups, with the parts of their scores."""
    best, trials = T.weight_search(_vectors(spark, d), "vec_id", {"style": _V[:5], "defense": _V[5:]}, {"style": 0.6, "defense": 0.4}, 4, 5, "defense")
    rows = [(k, r["weights"]["style"], r["silhouette"], r["davies_bouldin"], r["balance"], r["focus"], r["score"], r["weights"] == best) for k, r in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, style double, silhouette double, davies_bouldin double, balance double, focus double, score double, best boolean")


_Z = "WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS r, avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb FROM lineitem)"


@R("M05_pca", f"{_Z} SELECT l_suppkey, round(avg(((l_quantity - ma) / sa + sign(r) * (l_extendedprice - mb) / sb) / sqrt(2)), 6) AS pc1, round(any_value((1 + abs(r)) / 2), 6) AS explained FROM lineitem, s GROUP BY 1")
def m05(spark, d):
    """Two columns have a closed form: the first component explains (1 + |r|) / 2."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    m = T.pca(li, ["l_quantity", "l_extendedprice"], 1)
    return li.select("l_suppkey", *T.pca_columns(m)).groupBy("l_suppkey").agg(r6(F.avg("pc1"), "pc1")).withColumn("explained", F.round(F.lit(m["explained"][0]), 6))


def _playing(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count("*").alias("games"))
    return s.withColumns({"share": F.least(F.greatest((F.col("quantity") - 15) / 20, F.lit(0.0)), F.lit(1.0)), "usage": 20 + (F.col("discount") - 0.05) * 600})


@R("M16_staged_boosting")
def m16(spark, d):
    """Seasons before 1999 train; the later ones are predicted."""
    rows = _playing(spark, d)
    run = T.staged_boosting(rows.where("season < 1999"), ["quantity", "discount", "tax", "games"], "share", "usage", rounds=3, depth=3)
    got = run(rows.where("season >= 1999"))
    return got.select("l_suppkey", "season", *[r6(c) for c in ("p_rotation", "p_starter", "p_heavy", "p_usage", "expected_share", "expected_usage")])


@R("M17_quantile_interval", f"""WITH h AS (SELECT * FROM {_PRED} WHERE q <= 25), b AS (SELECT flag, quantile_cont(y - p, 0.1) AS a, quantile_cont(y - p, 0.9) AS z FROM h WHERE flag <> 'R' GROUP BY 1), w AS (SELECT quantile_cont(y - p, 0.1) AS a, quantile_cont(y - p, 0.9) AS z FROM h WHERE flag <> 'R')
SELECT x.flag, count(*) AS n, round(avg(least(p + coalesce(b.a, w.a), p)), 6) AS low, round(avg(greatest(p + coalesce(b.z, w.z), p)), 6) AS high FROM {_PRED} x LEFT JOIN b ON b.flag = x.flag, w WHERE q > 25 GROUP BY 1""")
def m17(spark, d):
    """Rows of small quantity are held out; one flag is not among them and takes the percentiles of all."""
    rows = predictions(spark, d)
    got = T.conformal_interval(rows.where("q <= 25 and flag <> 'R'"), rows.where("q > 25"), "y", "p", ["flag"])
    return got.groupBy("flag").agg(F.count("*").alias("n"), r6(F.avg("low"), "low"), r6(F.avg("high"), "high"))


_TWO = "covar_pop(l_extendedprice, l_discount) AS c1, covar_pop(l_extendedprice, l_quantity) AS c2, var_pop(l_discount) AS v1, var_pop(l_quantity) AS v2, covar_pop(l_discount, l_quantity) AS c12"


@R("M22_gated_weights", f"""WITH s AS (SELECT {_TWO} FROM lineitem WHERE year(l_shipdate) < 1999), w AS (SELECT c1 / v1 AS b0, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s),
e AS (SELECT stddev_pop(l_extendedprice - b0 * l_discount) AS base_std, stddev_pop(l_extendedprice - b1 * l_discount - b2 * l_quantity) AS more_std, any_value(b2) AS b2 FROM lineitem, w WHERE year(l_shipdate) >= 1999)
SELECT (base_std - more_std) / base_std >= 0.02 AS accepted, round(base_std, 4) AS base_std, round(more_std, 4) AS more_std, round(CASE WHEN (base_std - more_std) / base_std >= 0.02 THEN b2 ELSE 1.0 END, 4) AS weight FROM e""")
def m22(spark, d):
    li = table(spark, d, "lineitem")
    old = F.year("l_shipdate") < 1999
    g = T.gated_weights(li.where(old), li.where(~old), "l_extendedprice", ["l_discount"], ["l_quantity"], {"l_quantity": 1.0})
    return spark.range(1).select(F.lit(g["accepted"]).alias("accepted"), *[F.round(F.lit(float(v)), 4).alias(n) for n, v in (("base_std", g["base_std"]), ("more_std", g["more_std"]), ("weight", g["weights"]["l_quantity"]))])


@R("M29_residual_clusters")
def m29(spark, d):
    s = _playing(spark, d).withColumns({"e1": F.col("quantity") - 25.5, "e2": (F.col("discount") - 0.05) * 100, "e3": (F.col("tax") - 0.04) * 100})
    profile, _ = T.residual_clusters(s, "l_suppkey", ["e1", "e2", "e3"], [2, 3, 4, 5], "season")
    return profile.select("cluster", "n", r6("e1"), r6("e2"), r6("e3"))


@R("M30_k_sweep")
def m30(spark, d):
    return T.k_sweep(_vectors(spark, d), "vec_id", _V, [2, 4, 6]).select("k", r6("inertia"), r6("silhouette"), r6("separation"), r6("least_share"))
