"""Linear model, filter and scale queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import models as M
from lineup.plans.base import Registry, r6, table

R = Registry()


@R("M06_ridge_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def m06(spark, d):
    """One feature and no penalty: the closed form is the regression line."""
    m = M.ridge_fit(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.range(1).select(F.round(F.lit(m["coef"][0]), 4).alias("slope"), F.round(F.lit(m["intercept"]), 2).alias("intercept"))


@R("M07_project_value", "SELECT l_returnflag, round(avg(m.s * l_quantity + m.i - l_extendedprice), 2) AS mean_residual FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) m GROUP BY 1")
def m07(spark, d):
    li = table(spark, d, "lineitem")
    m = M.ridge_fit(li, "l_extendedprice", ["l_quantity"])
    return li.groupBy("l_returnflag").agg(F.round(F.avg(M.predict(m) - F.col("l_extendedprice")), 2).alias("mean_residual"))


@R("M26_linear_attribution")
def m26(spark, d):
    """Contributions of three features to each predicted price; they add up to prediction minus mean prediction."""
    li = table(spark, d, "lineitem")
    m = M.ridge_fit(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], alpha=1.0)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.explode(M.contributions(m)).alias("c")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "c.feature", r6("c.value", "value"))


@R("M08_kalman_series", """WITH RECURSIVE o AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, 10.0::DOUBLE AS m, 100.0::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, o.k, f.m + (f.v + 0.5) / (f.v + 0.5 + 4) * (o.y - f.m), (1 - (f.v + 0.5) / (f.v + 0.5 + 4)) * (f.v + 0.5) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, round(arg_max(m, k), 6) AS mean, round(arg_max(v, k), 6) AS variance FROM f GROUP BY 1""")
def m08(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").alias("y"), F.lit(4.0).alias("r")))).alias("o"))
    s = e.select("user_id", M.kalman_filter(F.col("o"), 0.5, F.lit(10.0), 100.0).alias("s"))
    return s.select("user_id", r6("s.m", "mean"), r6("s.v", "variance"))


@R("M20_interval_scale", "SELECT round(quantile_cont(abs(l_tax - l_discount) / (l_quantity / 100), 0.8), 6) AS scale FROM lineitem WHERE l_quantity > 0")
def m20(spark, d):
    rows = table(spark, d, "lineitem").withColumn("half", F.col("l_quantity") / 100)
    return M.interval_scale(rows, "l_tax", "l_discount", "half").select(r6("scale"))


@R("M21_grid_nll", """WITH x AS (SELECT quality::DOUBLE AS y, n_chars / 10000.0 AS x FROM documents d JOIN labels l ON l.doc_id = d.doc_id), g AS (SELECT unnest([-2.0, -1.0, -0.5, 0.0])::DOUBLE AS beta),
p AS (SELECT beta, y, least(greatest(1 / (1 + exp(-(1.5 + beta * x))), 1e-9), 1 - 1e-9) AS p FROM x, g) SELECT beta, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p))) + 0.25 * beta * beta, 4) AS nll FROM p GROUP BY 1""")
def m21(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10000.0).alias("x"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("quality").cast("double").alias("y"), "x", F.lit(1.5).alias("offset"))
    return M.grid_nll(rows, "y", "offset", "x", [-2.0, -1.0, -0.5, 0.0]).select("beta", F.round("nll", 4).alias("nll"))


@R("M23_usage_slope", "SELECT l_returnflag, CASE WHEN count(*) >= 50 THEN round(regr_slope(l_extendedprice, l_quantity), 4) ELSE 1.0 END AS slope FROM lineitem GROUP BY 1")
def m23(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.when(F.count("*") >= 50, F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4)).otherwise(1.0).alias("slope"))
