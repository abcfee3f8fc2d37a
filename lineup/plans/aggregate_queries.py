"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import aggregates as A
from lineup.operators.windows import group_max_flag, segment_id
from lineup.operators import tables as B
from lineup.plans.base import Registry, r6, table
from lineup.plans.window_queries import _YEARS, seasons

R = Registry()


@R("A01_shot_profile", """SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'A') AS "n_A", count_if(l_returnflag = 'N') AS "n_N", count_if(l_returnflag = 'R') AS "n_R", round(count_if(l_returnflag = 'A') / count(*)::DOUBLE, 6) AS "share_A" FROM lineitem GROUP BY 1""")
def a01(spark, d):
    return A.shot_profile(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"]).select("l_suppkey", "n", "n_A", "n_N", "n_R", r6("share_A"))


@R("A02_weighted_mean", "SELECT l_suppkey, round(coalesce(sum(l_discount * l_tax) / nullif(sum(l_tax), 0), avg(l_discount)), 6) AS mean FROM lineitem GROUP BY 1")
def a02(spark, d):
    return A.weighted_mean(table(spark, d, "lineitem"), "l_suppkey", "l_discount", "l_tax").select("l_suppkey", r6("mean"))


@R("A03_mode_by", "SELECT o_custkey, o_orderpriority AS mode, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def a03(spark, d):
    return A.mode_by(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "mode", "n")


@R("A04_distinct_counts", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS games, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a04(spark, d):
    return B.distinct_counts(table(spark, d, "lineitem"), "l_suppkey", games="l_orderkey", parts="l_partkey")


@R("A05_hhi", "SELECT l_orderkey, round(sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)), 9) AS hhi FROM lineitem GROUP BY 1")
def a05(spark, d):
    return A.hhi(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", F.round("hhi", 9).alias("hhi"))


@R("A06_filtered_aggregates", "SELECT c_nationkey, count_if(c_mktsegment = 'BUILDING') AS building, round(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END), 4) AS machinery, max(c_acctbal) FILTER (WHERE c_acctbal < 5000) AS top_low FROM customer GROUP BY 1")
def a06(spark, d):
    seg = F.col("c_mktsegment")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(seg == "BUILDING").alias("building"), F.round(F.sum(F.when(seg == "MACHINERY", F.col("c_acctbal")).otherwise(0)), 4).alias("machinery"), F.max(F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal"))).alias("top_low"))


_BENCH = """b AS (SELECT p_type, sum(l_discount * l_quantity) / sum(l_quantity) AS disc, sum(l_tax * l_quantity) / sum(l_quantity) AS tax FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
o AS (SELECT l_suppkey, p_type, sum(l_discount * l_quantity) / sum(l_quantity) AS disc, sum(l_tax * l_quantity) / sum(l_quantity) AS tax FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def _typed(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").join(p, "l_partkey").select("l_suppkey", "p_type", F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), "l_quantity")


@R("A08_league_benchmark", f"WITH {_BENCH} SELECT p_type, round(disc, 6) AS disc, round(tax, 6) AS tax FROM b")
def a08(spark, d):
    return A.benchmark(_typed(spark, d), "p_type", ["disc", "tax"], "l_quantity").select("p_type", r6("disc"), r6("tax"))


@R("A09_roster_gap", f"WITH {_BENCH} SELECT l_suppkey, p_type, round(greatest(0, b.disc - o.disc), 6) AS gap_disc, round(greatest(0, b.tax - o.tax), 6) AS gap_tax FROM o LEFT JOIN b USING (p_type)")
def a09(spark, d):
    rows = _typed(spark, d)
    own = A.benchmark(rows, ["l_suppkey", "p_type"], ["disc", "tax"], "l_quantity")
    return A.gap(own, A.benchmark(rows, "p_type", ["disc", "tax"], "l_quantity"), "p_type", ["disc", "tax"]).select("l_suppkey", "p_type", r6("gap_disc"), r6("gap_tax"))


@R("A11_value_counts", "SELECT o_custkey, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def a11(spark, d):
    rows = A.value_counts_map(table(spark, d, "orders"), "o_custkey", "o_orderstatus")
    return rows.select("o_custkey", F.concat_ws(",", F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))).alias("counts"))


@R("A13_median_impute", """WITH x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS v FROM customer), g AS (SELECT c_nationkey, quantile_cont(v, 0.5) AS m FROM x GROUP BY 1)
SELECT c_custkey, round(coalesce(v, m, (SELECT quantile_cont(v, 0.5) FROM x), 0), 6) AS v, (v IS NULL)::INT AS missing_count FROM x LEFT JOIN g USING (c_nationkey)""")
def a13(spark, d):
    x = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("v"))
    return A.median_impute(x, "c_nationkey", ["v"]).select("c_custkey", r6("v"), "missing_count")


@R("A15_eb_shrink", f"""WITH y AS (SELECT o_custkey, season, total / n AS raw, n::DOUBLE AS w, n FROM {_YEARS}), s AS (SELECT season, avg(raw) AS p FROM y GROUP BY 1)
SELECT o_custkey, season, round(p + w / (w + 8) * (raw - p), 4) AS shrunk FROM y JOIN s USING (season)""")
def a15(spark, d):
    y = seasons(spark, d).select("o_custkey", "season", (F.col("total") / F.col("n")).alias("raw"), F.col("n").cast("double").alias("w"))
    return A.eb_shrink(y, "raw", "w", 8.0, ["season"], []).select("o_custkey", "season", F.round("shrunk", 4).alias("shrunk"))


_LABELLED = "(SELECT source, lang, quality, (d.doc_id % 7 + 2000)::INT AS season FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("season", (F.col("doc_id") % 7 + 2000).cast("int"))


@R("A16_decayed_rates", f"""SELECT source, lang, round(sum(w), 6) AS n_eff, round(sum(w * quality) / sum(w), 6) AS rate FROM (SELECT *, pow(0.9, 2006 - season) AS w FROM {_LABELLED} WHERE season < 2006) GROUP BY GROUPING SETS ((source, lang), (source), ())""")
def a16(spark, d):
    return A.decayed_rates(labelled(spark, d), "quality", "season", 2006, [["source", "lang"], ["source"], []]).select("source", "lang", r6("n_eff"), r6("rate"))


@R("A17_hierarchical_shrinkage", f"""WITH w AS (SELECT *, pow(0.9, 2006 - season) AS w FROM {_LABELLED} WHERE season < 2006), g AS (SELECT sum(w * quality) / sum(w) AS r FROM w),
s AS (SELECT source, sum(w) AS n, sum(w * quality) / sum(w) AS r FROM w GROUP BY 1), c AS (SELECT source, lang, sum(w) AS n, sum(w * quality) / sum(w) AS r FROM w GROUP BY 1, 2),
h AS (SELECT source, (n * s.r + 15 * g.r) / (n + 15) AS r FROM s, g)
SELECT source, lang, round((c.n * c.r + 15 * h.r) / (c.n + 15), 6) AS rate FROM c JOIN h USING (source)""")
def a17(spark, d):
    rows = labelled(spark, d)
    rates = A.decayed_rates(rows, "quality", "season", 2006, [["source", "lang"], ["source"], []])
    cell = rates.where("level = 0").select("source", "lang", F.col("n_eff").alias("cn"), F.col("rate").alias("cr"))
    source = rates.where("level = 1").select("source", F.col("n_eff").alias("sn"), F.col("rate").alias("sr"))
    whole = rates.where("level = 3").select(F.col("n_eff").alias("gn"), F.col("rate").alias("gr"))  # one row
    out = cell.join(source, "source").crossJoin(F.broadcast(whole))
    return out.select("source", "lang", r6(A.shrink_chain([(F.col("gr"), F.col("gn")), (F.col("sr"), F.col("sn")), (F.col("cr"), F.col("cn"))], 15.0), "rate"))


@R("A18_expanding_window_score", f"""WITH x AS {_LABELLED}, s AS (SELECT DISTINCT source, season FROM x)
SELECT s.source, s.season, round(coalesce((SELECT avg(quality) FROM x WHERE x.source = s.source AND x.season < s.season), 0.5), 6) AS score FROM s""")
def a18(spark, d):
    """Per season only earlier seasons count: running sums over a season table, no driver loop and no self join."""
    from pyspark.sql.window import Window

    per = labelled(spark, d).groupBy("source", "season").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("source", "season", r6(F.coalesce(F.sum("good").over(w) / F.sum("n").over(w), F.lit(0.5)), "score"))


_PRED = "(SELECT l_tax AS y, l_discount AS p, l_quantity AS q, l_returnflag AS flag FROM lineitem)"


def predictions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_tax").alias("y"), F.col("l_discount").alias("p"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))


@R("A26_ece", """WITH x AS (SELECT least(n_chars / 10000.0, 1)::DOUBLE AS p, quality::DOUBLE AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id), e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM x),
b AS (SELECT len(list_filter(edges, lambda v: v < p)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM x, e GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b""")
def a26(spark, d):
    x = labelled(spark, d).select(F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("p"), F.col("quality").cast("double").alias("y"))
    return A.ece(x, "y", "p").select(r6("ece"))


@R("A27_tier_calibration", f"""SELECT tier, count(y) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM (SELECT unnest([1, 2, 3, 4, 5]) AS tier) LEFT JOIN (SELECT p, y, 1 + (q > 15)::INT + (q > 30)::INT + (q > 45)::INT AS tier FROM {_PRED}) USING (tier) GROUP BY 1""")
def a27(spark, d):
    from lineup.functions.scalars import tier_cut

    rows = predictions(spark, d).withColumn("tier", tier_cut(F.col("q"), [15.0001, 30.0001, 45.0001]))
    return A.calibration(rows, "y", "p", "tier", [1, 2, 3, 4, 5]).select("tier", "n", r6("predicted"), r6("actual"))


@R("A28_distribution_tvd", f"WITH b AS (SELECT floor(q / 5) AS b, count_if(flag = 'A') AS x, count_if(flag <> 'A') AS z FROM {_PRED} GROUP BY 1) SELECT round(sum(abs(x / (SELECT sum(x) FROM b)::DOUBLE - z / (SELECT sum(z) FROM b)::DOUBLE)) / 2, 6) AS tvd FROM b")
def a28(spark, d):
    rows = predictions(spark, d)
    return A.distribution_tvd(rows.where("flag = 'A'"), rows.where("flag <> 'A'"), "q", 5.0).select(r6("tvd"))


@R("A29_tail_metrics", f"SELECT round(avg((y >= 0.05)::INT), 6) AS actual_rate, round(avg((p >= 0.05)::INT), 6) AS predicted_rate, round(count_if(y >= 0.05 AND p >= 0.05) / count_if(p >= 0.05)::DOUBLE, 6) AS precision, round(count_if(y >= 0.05 AND p >= 0.05) / count_if(y >= 0.05)::DOUBLE, 6) AS recall FROM {_PRED}")
def a29(spark, d):
    return A.tail_metrics(predictions(spark, d), "y", "p", 0.05).select(r6("actual_rate"), r6("predicted_rate"), r6("precision"), r6("recall"))


@R("A29_brier", f"SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM {_PRED}")
def a29b(spark, d):
    return A.brier(predictions(spark, d), "y", "p").select("n", r6("brier"))


@R("A30_prediction_metrics", f"SELECT flag, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(p - y), 6) AS bias, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2 FROM {_PRED} GROUP BY 1")
def a30(spark, d):
    return A.regression_metrics(predictions(spark, d), "y", "p", "flag").select("flag", "n", r6("mae"), r6("rmse"), r6("bias"), r6("r2"))


@R("A32_interval_coverage", f"SELECT count(*) AS n, round(avg((y BETWEEN p - 0.02 AND p + 0.02)::INT), 6) AS coverage, round(avg((p + 0.02) - (p - 0.02)), 6) AS width FROM {_PRED}")
def a32(spark, d):
    rows = predictions(spark, d).withColumns({"low": F.col("p") - 0.02, "high": F.col("p") + 0.02})
    return A.interval_coverage(rows, "y", "low", "high").select("n", r6("coverage"), r6("width"))


@R("A36_profile", "SELECT feature, count(*) AS n, count_if(value IS NULL) AS nulls, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM (SELECT 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1")
def a36(spark, d):
    return A.profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@R("A37_corr_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def a37(spark, d):
    return A.corr_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r6("r"))


@R("A39_possession_metrics", """WITH s AS (SELECT user_id, ts, coalesce(sum(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS seg FROM (SELECT *, coalesce(lag(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS ends FROM events)),
g AS (SELECT user_id, seg, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS secs FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS segments, round(avg(secs), 6) AS mean_seconds FROM g WHERE secs BETWEEN 1 AND 500000 GROUP BY 1 HAVING count(*) > 5""")
def a39(spark, d):
    """Durations of segments in a valid range, per actor with more than five."""
    s = segment_id(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    g = s.groupBy("user_id", "segment_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("secs"))
    return g.where(F.col("secs").between(1, 500000)).groupBy("user_id").agg(F.count("*").alias("segments"), F.avg("secs").alias("m")).where("segments > 5").select("user_id", "segments", r6("m", "mean_seconds"))


@R("A40_event_rates", "SELECT user_id, round(count_if(event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate, round(count_if(event_type = 'purchase') / nullif(count_if(event_type = 'view'), 0)::DOUBLE, 6) AS purchase_per_view FROM events GROUP BY 1")
def a40(spark, d):
    n = lambda e: F.count_if(F.col("event_type") == e)
    return table(spark, d, "events").groupBy("user_id").agg(r6(n("error") / F.count("*"), "error_rate"), r6(n("purchase") / F.nullif(n("view"), F.lit(0)), "purchase_per_view"))


@R("A41_clutch_efficiency", "SELECT l_suppkey, round(sum(l_quantity) / (2 * count(*)), 6) AS efficiency FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m AND l_discount <= 0.05 GROUP BY 1")
def a41(spark, d):
    rows = group_max_flag(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "last").where(F.col("last") & (F.col("l_discount") <= 0.05))
    return rows.groupBy("l_suppkey").agg(r6(F.sum("l_quantity") / (2 * F.count("*")), "efficiency"))


@R("A45_reconcile", """WITH s AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT 'o_totalprice' AS field, round(avg((abs(o_totalprice - x) < 0.005)::INT), 6) AS match_rate, round(sum(abs(o_totalprice - x)), 2) AS total_delta FROM orders JOIN s USING (o_orderkey)""")
def a45(spark, d):
    detail = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return A.reconcile(detail, table(spark, d, "orders"), "o_orderkey", {"l_extendedprice": "o_totalprice"}).select("field", r6("match_rate"), F.round("total_delta", 2).alias("total_delta"))


@R("A46_identity_checks", "SELECT round(avg((length(text) = n_chars)::INT), 6) AS chars_match, round(avg((n_chars > 0)::INT), 6) AS not_empty FROM documents")
def a46(spark, d):
    return B.identity_checks(table(spark, d, "documents"), chars_match=F.length("text") == F.col("n_chars"), not_empty=F.col("n_chars") > 0).select(r6("chars_match"), r6("not_empty"))


@R("A47_career_summary", "SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS seasons, count(DISTINCT o_orderpriority) AS teams, min(year(o_orderdate)) AS first_season, max(year(o_orderdate)) AS last_season FROM orders GROUP BY 1")
def a47(spark, d):
    return A.career_summary(table(spark, d, "orders").withColumn("season", F.year("o_orderdate")), "o_custkey", "season", "o_orderpriority")


@R("A48_group_profile", "SELECT l_shipmode_, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1")
def a48(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_shipmode_", F.concat("l_returnflag", "l_linestatus"))
    return A.benchmark(rows, "l_shipmode_", ["l_quantity", "l_tax"]).select("l_shipmode_", r6("l_quantity"), r6("l_tax"))


@R("A49_pivot_mean", "SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 6) AS building, round(avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 6) AS machinery FROM customer GROUP BY 1")
def a49(spark, d):
    return A.pivot_mean(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "c_acctbal").select("c_nationkey", r6("BUILDING", "building"), r6("MACHINERY", "machinery"))
