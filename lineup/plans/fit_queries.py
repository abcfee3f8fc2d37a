"""Queries of reliabilities, shares, weighted scores and season tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions import fit
from lineup.operators import fit as ops
from lineup.plans.base import Registry, r6, table

R = Registry()


def _k(by: int):
    return F.col("p_partkey") % by


def _share(by: int, over: float):
    return _k(by) / F.lit(over)


@R("P32_confidence_adjust", "SELECT p_partkey, round(least(greatest(50 + least(coalesce(CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 13) / 10.0 END, 0), 1) * (coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2 END, 50) - 50), 10), 90)::DOUBLE, 6) AS score FROM part")
def p32(spark, d):
    score, confidence = F.when(_k(5) != 0, F.col("p_size") * 2), F.when(_k(7) != 0, _share(13, 10.0))
    return table(spark, d, "part").select("p_partkey", r6(fit.confidence_adjust(score, confidence), "score"))


_ABC = "SELECT p_partkey, (p_size * 2)::DOUBLE AS a, (p_partkey % 100)::DOUBLE AS b, (p_partkey % 240)::DOUBLE AS c FROM part"


def _abc(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).cast("double").alias("a"), _k(100).cast("double").alias("b"), _k(240).cast("double").alias("c"))


@R("P33_weighted_overall", f"SELECT p_partkey, round(least(greatest(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c, 0), 100), 6) AS score FROM ({_ABC})")
def p33(spark, d):
    return _abc(spark, d).select("p_partkey", r6(fit.weighted_overall({"a": 0.5, "b": 0.3, "c": 0.2}), "score"))


@R("P34_normalize_weights", f"SELECT p_partkey, round(least(greatest(0.6::DOUBLE * a + 0.2::DOUBLE * b + 0.2::DOUBLE * c, 0), 100), 6) AS score FROM ({_ABC})")
def p34(spark, d):
    rows = _abc(spark, d)
    weights = fit.normalize_weights({"a": 3, "b": 9, "c": 1, "absent": 2}, rows.columns, fixed="b")
    return rows.select("p_partkey", r6(fit.weighted_overall(weights), "score"))


@R("P40_reliability", "SELECT p_partkey, round(least((p_partkey % 30) / 20.0::DOUBLE, 1) * sqrt(least(p_size * 2 / 55.0::DOUBLE, 1)) * coalesce(CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 11) / 10.0::DOUBLE END, 0.5) * greatest(1 - 0.5::DOUBLE * (p_partkey % 9) / 6, 0.5), 6) AS reliability FROM part")
def p40(spark, d):
    position = F.when(_k(4) != 0, _share(11, 10.0))
    return table(spark, d, "part").select("p_partkey", r6(fit.reliability(_k(30), F.col("p_size") * 2, position, _k(9), 6), "reliability"))


@R("P43_uncertainty_multiplier", """WITH x AS (SELECT p_partkey, (p_partkey % 10) / 10.0::DOUBLE AS s, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 7) / 7.0::DOUBLE END AS p, (p_partkey % 5) / 5.0::DOUBLE AS m, p_partkey % 15 AS n, p_size AS w FROM part)
SELECT p_partkey, round(least(0.6::DOUBLE + 0.55::DOUBLE * (1 - s) + 0.25::DOUBLE * (1 - coalesce(p, 0.5)) + 0.1::DOUBLE + 0.09::DOUBLE + 0.18::DOUBLE * (1 - m) + least(0.25::DOUBLE, n * 0.025::DOUBLE), 2.1), 6) AS multiplier,
s < 0.45 AS low_sample, m < 0.75 AS low_match, w > 7.5 AS wide_projection FROM x""")
def p43(spark, d):
    known = {"sample": _share(10, 10.0), "projection": F.when(_k(4) != 0, _share(7, 7.0)), "match": _share(5, 5.0)}
    flags = fit.quality_flags(known, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", r6(fit.uncertainty_multiplier(known, _k(15)), "multiplier"), *[flags[c].alias(c) for c in ("low_sample", "low_match", "wide_projection")])


@R("P45_split_displaced", """WITH x AS (SELECT p_partkey, p_size::DOUBLE AS e, least((p_partkey % 4) * 70, 200)::DOUBLE AS o FROM part), y AS (SELECT *, least(e, CASE WHEN o > 0 THEN o / 5 ELSE e * 0.35::DOUBLE END) AS slot FROM x)
SELECT p_partkey, round(slot, 6) AS replacement_slot, round((e - slot) * 0.65::DOUBLE, 6) AS same_position_depth, round((e - slot) * 0.35::DOUBLE, 6) AS flexible_bench FROM y""")
def p45(spark, d):
    return table(spark, d, "part").select("p_partkey", fit.split_displaced(F.col("p_size"), _k(4) * 70, 6).alias("s")).select("p_partkey", "s.*")


@R("P47_survival_share", """WITH x AS (SELECT p_partkey, (p_partkey % 11) / 10.0::DOUBLE AS r, (p_partkey % 7) / 6.0::DOUBLE AS s, (p_size % 5) / 4.0::DOUBLE AS h FROM part), y AS (SELECT p_partkey, r, least(r, s) AS s, least(r, s, h) AS h FROM x)
SELECT p_partkey, round(0.1::DOUBLE * (1 - r) + 0.45::DOUBLE * (r - s) + 0.7::DOUBLE * (s - h) + 0.875::DOUBLE * h, 6) AS share FROM y""")
def p47(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(fit.survival_share(_share(11, 10.0), _share(7, 6.0), (F.col("p_size") % 5) / 4.0), "share"))


@R("A23_returning_pct", "SELECT p_partkey, round((p_size + p_partkey % 10) / (p_size + p_partkey % 10 + greatest(p_partkey % 17, p_partkey % 23))::DOUBLE, 6) AS returning_pct FROM part")
def a23(spark, d):
    one = lambda x: F.create_map(F.lit("G"), x.cast("double"))
    back = F.create_map(F.lit("G"), F.col("p_size").cast("double"), F.lit("F"), _k(10).cast("double"))
    return table(spark, d, "part").select("p_partkey", r6(fit.returning_share(back, one(_k(17)), one(_k(23))), "returning_pct"))


@R("M28_predict_batch", "SELECT p_partkey, round(1.5::DOUBLE + 0.25::DOUBLE * p_size, 6) AS first, round(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size END, 0) * 2::DOUBLE - 0.01::DOUBLE * p_partkey, 6) AS second FROM part")
def m28(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.when(_k(3) != 0, F.col("p_size")).alias("x"))
    models = fit.predict_batch({"first": (1.5, {"p_size": 0.25}), "second": (0.0, {"x": 2.0, "p_partkey": -0.01})})
    return rows.select("p_partkey", *[r6(c, n) for n, c in models.items()])


@R("S09_season_replace", "SELECT o_orderkey, year(o_orderdate)::INT AS season, CASE WHEN year(o_orderdate) IN (1995, 1996) THEN 2 * o_totalprice ELSE o_totalprice END AS price FROM orders")
def s09(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("price"))
    return ops.season_replace(rows, rows.where("season in (1995, 1996)").withColumn("price", F.col("price") * 2), "season")


@R("J25_returning_status", """WITH s AS (SELECT o_custkey, year(o_orderdate)::INT AS season, min(o_orderpriority) AS owner FROM orders GROUP BY ALL)
SELECT n.o_custkey, n.season, n.owner, CASE WHEN n.o_custkey % 10 = 0 OR p.owner IS NULL THEN 'new' WHEN p.owner = n.owner THEN 'returning' ELSE 'transfer_in' END AS status FROM s n LEFT JOIN s p ON p.o_custkey = n.o_custkey AND p.season = n.season - 1""")
def j25(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.min("o_orderpriority").alias("owner"))
    return ops.returning_status(rows, "o_custkey", "season", "owner", F.col("o_custkey") % 10 == 0)


@R("A25_group_priors", """WITH n AS (SELECT * FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'), g AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM n GROUP BY 1)
SELECT c_custkey, round(coalesce(g.m, (SELECT avg(c_acctbal) FROM n))::DOUBLE, 4) AS prior, round((0.25::DOUBLE * coalesce(g.m, (SELECT avg(c_acctbal) FROM n)) + 0.75::DOUBLE * c_acctbal)::DOUBLE, 4) AS blended FROM customer LEFT JOIN g USING (c_mktsegment)""")
def a25(spark, d):
    newcomer = (F.col("c_custkey") % 3 == 0) & (F.col("c_mktsegment") != "BUILDING")
    rows = ops.group_priors(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", newcomer, "c_acctbal", F.lit(0.25), F.col("c_acctbal"))
    return rows.select("c_custkey", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("prior", "blended")])
