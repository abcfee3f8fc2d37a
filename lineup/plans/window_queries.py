"""Window, calibration and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions.fit import confidence_adjust, weighted_overall
from lineup.operators import topk, windows as W
from lineup.plans.base import Registry, r6, sql_score, table
from lineup.sources.io import stage

R = Registry()
WEIGHTS = {"scheme": 0.25, "gap": 0.30, "role": 0.25, "program": 0.20}


def _calibrated(value: str, group: str, source: str, out: str, more: str = "*") -> str:
    p = f"((rank() OVER (PARTITION BY {group} ORDER BY {value}) + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0 - 0.5) / count({value}) OVER (PARTITION BY {group}))::DOUBLE"
    return f"SELECT {more}, {sql_score('p_')} AS {out} FROM (SELECT *, {p} AS p_ FROM {source})"


@R("W01_calibrate_within", f"SELECT c_custkey, c_nationkey, round(fit, 6) AS fit FROM ({_calibrated('c_acctbal', 'c_nationkey', 'customer', 'fit')})")
def w01(spark, d):
    return W.calibrate_within(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "fit").select("c_custkey", "c_nationkey", r6("fit"))


_PAIRS = """(SELECT c_custkey, c_nationkey, c_acctbal AS scheme, coalesce(total, 0) AS gap, coalesce(n, 0)::DOUBLE AS role, 50.0 AS program,
  least(coalesce(n, 0) / 10.0, 1.0) AS confidence
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _pairs(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 4).alias("total"), F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(per, "c_custkey", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("scheme"), F.coalesce("total", F.lit(0.0)).alias("gap"), n.cast("double").alias("role"), F.lit(50.0).alias("program"), F.least(n / 10.0, F.lit(1.0)).alias("confidence"))


_FIT = f"""
WITH p AS {_PAIRS.replace('sum(o_totalprice)', 'round(sum(o_totalprice), 4)')},
a AS ({_calibrated('scheme', 'c_nationkey', 'p', 'scheme_c')}),
b AS ({_calibrated('gap', 'c_nationkey', '(SELECT * EXCLUDE (p_) FROM a)', 'gap_c')}),
c AS ({_calibrated('role', 'c_nationkey', '(SELECT * EXCLUDE (p_) FROM b)', 'role_c')}),
o AS (SELECT * EXCLUDE (p_), round(0.25 * scheme_c + 0.30 * (50 + (gap_c - 50) * confidence) + 0.25 * (50 + (role_c - 50) * confidence) + 0.20 * program, 6) AS overall FROM c),
f AS ({_calibrated('overall', 'c_nationkey', 'o', 'fit')})
SELECT c_custkey, c_nationkey, round(scheme_c, 6) AS scheme_c, round(gap_c, 6) AS gap_c, round(role_c, 6) AS role_c, overall, round(fit, 6) AS fit,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY round(fit, 6) DESC, c_custkey) AS place FROM f"""


@R("C06_fit_calibration", f"SELECT * FROM ({_FIT}) WHERE place <= 10")
def c06(spark, d):
    """Calibrate each component in its school, shrink by confidence, weigh, calibrate again, keep the ten best."""
    rows = W.calibrate_many(stage(_pairs(spark, d), "fit-pairs"), "c_nationkey", {c: f"{c}_c" for c in ("scheme", "gap", "role")})
    held = rows.withColumns({"scheme": F.col("scheme_c"), "gap": confidence_adjust(F.col("gap_c"), F.col("confidence")), "role": confidence_adjust(F.col("role_c"), F.col("confidence"))})
    overall = held.withColumn("overall", F.round(weighted_overall(WEIGHTS), 6))
    fit = W.calibrate_within(stage(overall, "fit-overall"), "c_nationkey", "overall", "fit").select("c_custkey", "c_nationkey", r6("scheme_c"), r6("gap_c"), r6("role_c"), "overall", r6("fit"))
    return topk.top_n(fit, "c_nationkey", 10, F.desc("fit"), F.col("c_custkey")).withColumn("place", F.col("place").cast("long"))


for _rule, _p in (
    ("min", "percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal)"),
    ("share", "cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal)"),
    ("average", "(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0) / count(*) OVER (PARTITION BY s_nationkey)"),
):

    @R(f"W02_tier_{_rule}", f"SELECT s_suppkey, CASE WHEN p >= 0.75 THEN 1 WHEN p >= 0.45 THEN 2 WHEN p >= 0.2 THEN 3 ELSE 4 END AS tier FROM (SELECT *, {_p} AS p FROM supplier)")
    def w02(spark, d, rule=_rule):
        return W.competition_tier(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "tier", rule).select("s_suppkey", "tier")


_YEARS = "(SELECT o_custkey, year(o_orderdate) AS season, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM orders GROUP BY 1, 2)"


def seasons(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.round(F.sum("o_totalprice"), 4).alias("total"), F.count("*").alias("n"))


@R("W03_quantile_bucket", f"""WITH y AS {_YEARS}, e AS (SELECT season, quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.5) AS b, quantile_cont(total, 0.75) AS c FROM y GROUP BY 1)
SELECT o_custkey, season, (1 + (total > a)::INT + (total > b AND b > a)::INT + (total > c AND c > b)::INT) AS bucket FROM y JOIN e USING (season)""")
def w03(spark, d):
    return W.quantile_bucket(seasons(spark, d), "season", "total", "bucket").select("o_custkey", "season", "bucket")


@R("W04_pct_rank", f"""SELECT o_custkey, season, round(100 - 100 * (rank() OVER (PARTITION BY season ORDER BY n) + (count(*) OVER (PARTITION BY season, n) - 1) / 2.0) / count(*) OVER (PARTITION BY season), 6) AS pct FROM {_YEARS}""")
def w04(spark, d):
    return W.pct_rank(seasons(spark, d), "season", "n", "pct", inverted=True).select("o_custkey", "season", r6("pct"))


@R("W05_zscore_by", f"""SELECT o_custkey, season, round(CASE WHEN count(*) OVER w >= 2 AND stddev_pop(total) OVER w > 0 THEN (total - avg(total) OVER w) / stddev_pop(total) OVER w ELSE 0 END, 6) AS z FROM {_YEARS} WINDOW w AS (PARTITION BY season)""")
def w05(spark, d):
    return W.zscore_by(seasons(spark, d), "season", "total", "z").select("o_custkey", "season", r6("z"))


@R("W06_career_index", f"SELECT o_custkey, season, row_number() OVER (PARTITION BY o_custkey ORDER BY season) AS career_index FROM {_YEARS}")
def w06(spark, d):
    return W.career_index(seasons(spark, d), "o_custkey", "season").select("o_custkey", "season", "career_index")


@R("W07_lag1_autocorr", f"""WITH p AS (SELECT total, lead(total) OVER (PARTITION BY o_custkey ORDER BY season) AS nxt FROM {_YEARS})
SELECT count(*) AS pairs, round(CASE WHEN count(*) >= 50 THEN least(greatest(corr(total, nxt), 0.2), 0.95) END, 6) AS rho FROM p WHERE nxt IS NOT NULL""")
def w07(spark, d):
    return W.lag1_autocorr(seasons(spark, d), "o_custkey", "season", "total").select("pairs", r6("rho"))


@R("W08_segment_id", """SELECT event_id, user_id, coalesce(sum(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS segment_id
FROM (SELECT *, coalesce(lag(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS ends FROM events)""")
def w08(spark, d):
    return W.segment_id(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", "segment_id")


@R("W09_group_max_flag", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_line FROM lineitem")
def w09(spark, d):
    return W.group_max_flag(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "last_line").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "last_line")


@R("W10_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w10(spark, d):
    return W.latest_per_key(table(spark, d, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@R("W11_national_percentile", f"""SELECT o_custkey, season, round(100 * cume_dist() OVER (PARTITION BY season ORDER BY total), 6) AS national_pct, rank() OVER (PARTITION BY season, c_nationkey ORDER BY total DESC) AS group_rank
FROM {_YEARS} JOIN customer ON c_custkey = o_custkey""")
def w11(spark, d):
    rows = seasons(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = stage(rows.select("o_custkey", "season", "c_nationkey", "total"), "percentile")  # read by every step of the two ranks
    return W.national_percentile(rows, "total", "c_nationkey").select("o_custkey", "season", r6("national_pct"), "group_rank")


@R("W12_cascade_reduce", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_quantity, greatest(0, 30 - coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS reduced FROM lineitem""")
def w12(spark, d):
    return W.cascade_reduce(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.lit(30.0), ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "reduced")


@R("W13_qualifying_owner", """SELECT user_id, segment_id, arg_min(event_type, event_id) AS owner FROM (SELECT event_id, event_type, value, user_id, coalesce(sum(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS segment_id
FROM (SELECT *, coalesce(lag(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS ends FROM events)) WHERE value > 20 GROUP BY 1, 2""")
def w13(spark, d):
    rows = W.segment_id(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return W.qualifying_owner(rows, ["user_id", "segment_id"], "event_type", "event_id", F.col("value") > 20)


@R("J05_priority_resolve", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def j05(spark, d):
    return W.priority_resolve(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@R("T01_two_stage_topk", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p1 FROM customer),
b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal * 0.5 + (c_custkey % 97) * 40.0 DESC, c_custkey) AS p2 FROM a WHERE p1 <= 50)
SELECT c_nationkey, c_custkey, p1::INT AS place1, p2::INT AS place2 FROM b WHERE p2 <= 10""")
def t01(spark, d):
    rows = topk.two_stage_topk(table(spark, d, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal"), F.col("c_acctbal") * 0.5 + (F.col("c_custkey") % 97) * 40.0)
    return rows.select("c_nationkey", "c_custkey", "place1", "place2")


@R("T02_explain_funnel", """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
SELECT c_nationkey, c_custkey, place::INT AS place, place <= 10 AS kept, round(c_acctbal - min(CASE WHEN place <= 10 THEN c_acctbal END) OVER (PARTITION BY c_nationkey), 6) AS margin FROM r""")
def t02(spark, d):
    return topk.explain_funnel(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 10).select("c_nationkey", "c_custkey", "place", "kept", r6("margin"))


@R("T05_dedupe_keep_best", "SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def t05(spark, d):
    return W.latest_per_key(table(spark, d, "part"), "p_name", F.desc("p_retailprice"), F.col("p_partkey")).select("p_name", "p_partkey", "p_retailprice")


@R("T07_best_of", "SELECT c_nationkey, (SELECT 1) * arg_max(c_custkey, struct_pack(a := c_acctbal, b := -c_custkey)) AS best_c_acctbal FROM customer GROUP BY 1")
def t07(spark, d):
    return topk.best_of(table(spark, d, "customer"), "c_nationkey", "c_custkey", ["c_acctbal"])


@R("T10_n_extremes", """SELECT s_nationkey, s_suppkey, s_acctbal, side FROM (SELECT *, 'high' AS side, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier
UNION ALL SELECT *, 'low' AS side, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) WHERE r <= 2""")
def t10(spark, d):
    s = table(spark, d, "supplier")
    high = topk.top_n(s, "s_nationkey", 2, F.desc("s_acctbal"), F.col("s_suppkey")).withColumn("side", F.lit("high"))
    low = topk.top_n(s, "s_nationkey", 2, F.col("s_acctbal"), F.col("s_suppkey")).withColumn("side", F.lit("low"))
    return high.unionByName(low).select("s_nationkey", "s_suppkey", "s_acctbal", "side")
