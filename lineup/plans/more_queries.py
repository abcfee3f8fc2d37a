"""Further cleaning, history, cohort and product queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions import scalars as S
from lineup.operators import aggregates as A
from lineup.operators import extras as E
from lineup.operators import joins as J
from lineup.operators import models as M
from lineup.operators import topk
from lineup.operators import windows as W
from lineup.operators.order import quantiles
from lineup.plans.aggregate_queries import _LABELLED, _PRED, labelled, predictions
from lineup.operators import tables as B
from lineup.plans.base import Registry, r6, table
from lineup.plans.join_queries import _split, _SPLIT
from lineup.plans.window_queries import _YEARS, seasons

R = Registry()
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@R("P10_name_tokens", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last FROM part")
def p10(spark, d):
    first, last = S.first_last(F.concat(F.col("p_name"), F.lit(" III")))
    return table(spark, d, "part").select("p_partkey", first.alias("first"), last.alias("last"))


@R("P13_quality_gate", "SELECT c_custkey FROM customer WHERE (c_acctbal < 0)::INT + (c_custkey % 2 = 0)::INT + (c_mktsegment = 'BUILDING')::INT <= 1 AND c_nationkey >= 3")
def p13(spark, d):
    c = table(spark, d, "customer")
    rows = c.withColumns({"a": F.when(F.col("c_acctbal") >= 0, 1), "b": F.when(F.col("c_custkey") % 2 != 0, 1), "e": F.when(F.col("c_mktsegment") != "BUILDING", 1)})
    return E.quality_gate(rows, {"c_nationkey": 3}, ["a", "b", "e"], 1).select("c_custkey")


@R("P14_both_sides_in", f"SELECT {_LINE} FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def p14(spark, d):
    ids = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return E.both_sides_in(table(spark, d, "lineitem"), ids, "s_suppkey", "l_suppkey", "l_partkey").select(*LINE)


@R("P17_shot_class", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'three' WHEN event_type = 'view' THEN 'rim' ELSE 'mid' END ELSE CASE WHEN event_id % 30 > 20 THEN 'three' WHEN event_type = 'view' THEN 'rim' ELSE 'mid' END END AS label FROM events")
def p17(spark, d):
    e = F.col("event_id")
    points = F.when(e % 4 == 0, F.when(e % 3 == 0, 3).otherwise(2))
    return table(spark, d, "events").select("event_id", E.shot_class(points, F.col("event_type"), ["view"], (e % 30).cast("double"), 20.0).alias("label"))


@R("P18_actor_from_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS actor FROM part")
def p18(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("end of period")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" makes a layup assist by x"))).otherwise(F.concat("p_name", F.lit(" misses a shot")))
    return table(spark, d, "part").select("p_partkey", E.actor_from_text(text, [" makes ", " misses "]).alias("actor"))


@R("P19_unit_autodetect", "SELECT c_custkey, round(least(greatest(CASE WHEN m > 1.5 THEN c_acctbal / 100 ELSE c_acctbal END, 0), 1), 6) AS share FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer WHERE c_acctbal > 0)")
def p19(spark, d):
    return E.unit_autodetect(table(spark, d, "customer"), "c_acctbal", "share").select("c_custkey", r6("share"))


@R("P20_mask_leaky", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def p20(spark, d):
    return E.mask_leaky(table(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@R("P23_threshold_filters", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size >= 10 AND p_retailprice >= 950")
def p23(spark, d):
    return E.threshold_filters(table(spark, d, "part"), {"p_brand": ["Brand#1", "Brand#2", "Brand#3"]}, {"p_size": 10, "p_retailprice": 950, "unknown_stat": 1}).select("p_partkey")


@R("P24_substring_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' ORDER BY p_name, p_partkey LIMIT 20")
def p24(spark, d):
    return B.substring_search(table(spark, d, "part"), "p_name", "RING", 20, "p_partkey").select("p_partkey", "p_name")


@R("P28_pace_match", "SELECT s_suppkey, round(CASE WHEN s_suppkey % 5 = 0 THEN 50 ELSE greatest(0, 1 - abs(s_acctbal - 4000) / 6000) * 100 END, 6) AS pace FROM supplier")
def p28(spark, d):
    p = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", r6(F.when(p.isNull(), 50.0).otherwise(S.pace_match(p, F.lit(4000.0), F.lit(6000.0))), "pace"))


@R("P37_position_lookup", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS minutes FROM part")
def p37(spark, d):
    values = F.create_map(F.lit("PG"), F.lit(1.0), F.lit("G"), F.lit(2.0), F.lit("total"), F.lit(3.0))
    k = F.col("p_size") % 3
    return table(spark, d, "part").select("p_partkey", S.position_lookup(values, F.when(k == 0, "PG").otherwise("XX"), F.when(k == 1, "G").otherwise("YY")).alias("minutes"))


@R("P38_map_difference", "SELECT c_nationkey, round(sum(c_acctbal) - count(*), 4) AS left_total FROM customer GROUP BY 1")
def p38(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("a"), F.count("*").cast("double").alias("n"))
    diff = S.map_difference(F.create_map(F.lit("x"), F.col("a")), F.create_map(F.lit("x"), F.col("n")))
    return g.select("c_nationkey", F.round(diff["x"], 4).alias("left_total"))


@R("P41_calibrate_to_baseline", "SELECT p_partkey, round(w * p_retailprice + (1 - w) * 15, 6) AS score FROM (SELECT *, p_size / 50.0 AS w FROM part)")
def p41(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.calibrate_to_baseline(F.col("p_retailprice"), F.col("p_size") / 50.0), "score"))


_DIST = "list_sort([abs(p_size - 5)::DOUBLE, abs(p_size - 22)::DOUBLE, abs(p_size - 41)::DOUBLE])"


@R("P53_cluster_confidence", f"SELECT p_partkey, round(CASE WHEN {_DIST}[2] > 0 THEN 1 - {_DIST}[1] / {_DIST}[2] ELSE 0 END, 6) AS confidence FROM part")
def p53(spark, d):
    x = F.array(*[F.abs(F.col("p_size") - c).cast("double") for c in (5, 22, 41)])
    return table(spark, d, "part").select("p_partkey", r6(S.cluster_confidence(x), "confidence"))


@R("P54_soft_memberships", """WITH x AS (SELECT p_partkey, unnest([0, 1, 2]) AS cluster, unnest([abs(p_size - 5), abs(p_size - 22), abs(p_size - 41)])::DOUBLE AS dist FROM part),
w AS (SELECT *, exp(-(dist - min(dist) OVER k) / greatest(avg(dist) OVER k, 1e-9)) AS raw FROM x WINDOW k AS (PARTITION BY p_partkey))
SELECT p_partkey, cluster, round(raw / sum(raw) OVER (PARTITION BY p_partkey), 6) AS weight FROM w""")
def p54(spark, d):
    x = F.array(*[F.abs(F.col("p_size") - c).cast("double") for c in (5, 22, 41)])
    return table(spark, d, "part").select("p_partkey", F.explode(S.soft_memberships(x)).alias("m")).select("p_partkey", "m.cluster", r6("m.weight", "weight"))


@R("P55_combine_memberships", "SELECT c_nationkey, a, b, round((x * y)::DOUBLE, 6) AS weight FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT 0 AS a, 0.6 AS x UNION ALL SELECT 1, 0.4), (SELECT 0 AS b, 0.7 AS y UNION ALL SELECT 1, 0.3)")
def p55(spark, d):
    m = lambda p: F.array(*[F.struct(F.lit(k).alias("cluster"), F.lit(w).alias("weight")) for k, w in enumerate(p)])
    rows = table(spark, d, "customer").select("c_nationkey").distinct().select("c_nationkey", F.explode(E.combine_memberships(m([0.6, 0.4]), m([0.7, 0.3]), 4)).alias("m"))
    return rows.select("c_nationkey", "m.a", "m.b", r6("m.weight", "weight"))


@R("P57_explain_text", "SELECT o_custkey, CASE WHEN count(*) >= 20 THEN 'based on ' || count(*) || ' seasons rows' WHEN count(*) >= 5 THEN 'based on few rows: ' || count(*) ELSE 'based on the overall rate' END AS sentence FROM orders GROUP BY 1")
def p57(spark, d):
    n = F.col("n")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.select("o_custkey", F.when(n >= 20, F.format_string("based on %d seasons rows", n)).when(n >= 5, F.format_string("based on few rows: %d", n)).otherwise("based on the overall rate").alias("sentence"))


@R("P64_cohort_bucket", f"SELECT o_custkey, season, CASE WHEN n <= 1 THEN 'low' WHEN n <= 3 THEN 'mid' ELSE 'high' END AS cohort FROM {_YEARS}")
def p64(spark, d):
    n = F.col("n")
    return seasons(spark, d).select("o_custkey", "season", B.cohort_bucket(n, [1, 3], ["low", "mid", "high"]).alias("cohort"))


@R("P65_success_label", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax > 0.01 THEN l_discount >= l_tax WHEN l_linenumber > 2 THEN l_quantity >= 25 END AS success, CASE WHEN l_tax > 0.01 THEN 'projected' WHEN l_linenumber > 2 THEN 'earlier' ELSE 'none' END AS rule FROM lineitem")
def p65(spark, d):
    projected = F.when(F.col("l_tax") > 0.01, F.col("l_tax"))
    before = F.when(F.col("l_linenumber") > 2, F.lit(25.0))
    label, rule = E.success_label(F.col("l_discount"), projected, before, F.col("l_quantity"))
    return table(spark, d, "lineitem").select(*LINE, label.alias("success"), rule.alias("rule"))


@R("A07_soft_position_sum", "SELECT c_nationkey, round(sum(c_acctbal * 0.6), 4) AS pg, round(sum(c_acctbal * 0.4), 4) AS sg FROM customer GROUP BY 1")
def a07(spark, d):
    rows = table(spark, d, "customer").withColumn("p", F.array(F.lit(0.6), F.lit(0.4)))
    out = E.soft_position_sum(rows, "c_nationkey", "c_acctbal", "p", ["pg", "sg"])
    return out.select("c_nationkey", F.round("pg", 4).alias("pg"), F.round("sg", 4).alias("sg"))


@R("A10_distribution_deficit", """WITH l AS (SELECT l_returnflag AS label, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS s FROM lineitem GROUP BY 1), k AS (SELECT DISTINCT l_suppkey FROM lineitem),
o AS (SELECT l_suppkey, l_returnflag AS label, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey)::DOUBLE AS s FROM lineitem GROUP BY 1, 2),
x AS (SELECT k.l_suppkey, l.label, round(l.s - coalesce(o.s, 0), 9) AS deficit FROM k CROSS JOIN l LEFT JOIN o ON o.l_suppkey = k.l_suppkey AND o.label = l.label)
SELECT l_suppkey, label, round(deficit, 6) AS deficit FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY deficit DESC, label) AS r FROM x WHERE deficit > 0) WHERE r <= 2""")
def a10(spark, d):
    return E.distribution_deficit(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 2).select("l_suppkey", "label", r6("deficit"))


@R("A12_roster_state", f"""WITH y AS {_YEARS}, k AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS id, a.total AS before, b.total AS now, c_nationkey FROM (SELECT * FROM y WHERE season = 1996) a FULL JOIN (SELECT * FROM y WHERE season = 1997) b ON a.o_custkey = b.o_custkey JOIN customer ON c_custkey = coalesce(a.o_custkey, b.o_custkey))
SELECT c_nationkey, round(sum(coalesce(before, 0)), 2) AS prior, round(sum(CASE WHEN now IS NOT NULL THEN coalesce(before, 0) ELSE 0 END), 2) AS returning_, round(sum(CASE WHEN now IS NULL THEN before ELSE 0 END), 2) AS departing, count_if(before IS NULL) AS incoming FROM k GROUP BY 1""")
def a12(spark, d):
    y = seasons(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    tagged = y.where("season in (1996, 1997)").join(c, "o_custkey")
    out = E.roster_state(tagged, "c_nationkey", "o_custkey", "season", "total", 1996, 1997)
    return out.select("c_nationkey", F.round("prior", 2).alias("prior"), F.round("returning_", 2).alias("returning_"), F.round("departing", 2).alias("departing"), "incoming")


@R("A14_hierarchical_mean_prior", f"WITH y AS {_YEARS} SELECT o_custkey, season, round(avg(total) OVER (PARTITION BY season, n), 4) AS prior FROM y")
def a14(spark, d):
    y = seasons(spark, d)
    return A.hierarchical_mean_prior(y, "total", ["season", "n"], ["season"], []).select("o_custkey", "season", F.round("prior", 4).alias("prior"))


@R("A19_season_mean_std", f"SELECT season, count(*) AS n, round(avg(total), 4) AS mean, round(stddev_pop(total), 4) AS std FROM {_YEARS} GROUP BY 1")
def a19(spark, d):
    return seasons(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg("total"), 4).alias("mean"), F.round(F.stddev_pop("total"), 4).alias("std"))


@R("A20_attempt_rates", "SELECT l_suppkey, round(sum(l_linenumber) * 40.0 / sum(l_quantity), 6) AS per40 FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 200")
def a20(spark, d):
    return E.attempt_rates(table(spark, d, "lineitem"), "l_suppkey", {"per40": "l_linenumber"}, "l_quantity", 200.0).select("l_suppkey", r6("per40"))


@R("A24_tier_matrix", """WITH x AS (SELECT (c_nationkey % 4 + 1)::INT AS a, (c_custkey % 3 + 1)::INT AS b, c_acctbal / 1000 AS v FROM customer), g AS (SELECT a.t AS a, b.t AS b FROM (SELECT unnest([1, 2, 3, 4]) AS t) a, (SELECT unnest([1, 2, 3, 4]) AS t) b),
m AS (SELECT a, b, count(*) AS n, avg(v) AS mean FROM x GROUP BY 1, 2)
SELECT g.a AS source_tier, g.b AS target_tier, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) >= 20 THEN 0.8 * p + 0.2 * mean ELSE p END, 6) AS effect
FROM (SELECT *, CASE WHEN b < a THEN -0.25 * (a - b) ELSE 0.15 * (b - a) END AS p FROM g) g LEFT JOIN m ON m.a = g.a AND m.b = g.b""")
def a24(spark, d):
    x = table(spark, d, "customer").select((F.col("c_nationkey") % 4 + 1).cast("int").alias("a"), (F.col("c_custkey") % 3 + 1).cast("int").alias("b"), (F.col("c_acctbal") / 1000).alias("v"))
    return E.tier_matrix(x, "a", "b", "v").select("source_tier", "target_tier", "n", r6("effect"))


@R("A31_spearman", f"""WITH r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY flag ORDER BY p) + (count(*) OVER (PARTITION BY flag, p) - 1) / 2.0 AS b FROM {_PRED}) SELECT flag, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def a31(spark, d):
    rows = W.with_average_rank(W.with_average_rank(predictions(spark, d).select("flag", "y", "p"), "y", "flag", "a"), "p", "flag", "b")
    return rows.groupBy("flag").agg(r6(F.corr("a", "b"), "spearman"))


@R("A33_residual_summary", f"SELECT flag, count(*) AS n, round(avg(p - y), 6) AS mean, round(quantile_cont(round(p - y, 6), 0.5), 6) AS median, round(avg(abs(p - y)), 6) AS mae FROM {_PRED} GROUP BY 1 HAVING count(*) >= 30")
def a33(spark, d):
    return E.residual_summary(predictions(spark, d), "y", "p", "flag", 30).select("flag", "n", r6("mean"), r6("median"), r6("mae"))


@R("A34_bucket_calibration", f"SELECT least(floor(p * 100 / 2), 4)::INT AS bucket, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM {_PRED} GROUP BY 1")
def a34(spark, d):
    rows = predictions(spark, d).withColumn("bucket", F.least(F.floor(F.col("p") * 100 / 2), F.lit(4)).cast("int"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("p"), "predicted"), r6(F.avg("y"), "actual"))


@R("A35_baseline_compare", f"""WITH x AS (SELECT *, q <= 25 AS train FROM {_PRED}), g AS (SELECT flag, avg(y) AS m FROM x WHERE train GROUP BY 1), w AS (SELECT avg(y) AS m FROM x WHERE train)
SELECT round(sqrt(avg((p - y) * (p - y))), 6) AS model, round(sqrt(avg((w.m - y) * (w.m - y))), 6) AS mean, round(sqrt(avg((g.m - y) * (g.m - y))), 6) AS group_mean FROM x JOIN g USING (flag), w WHERE NOT train""")
def a35(spark, d):
    return E.baseline_compare(predictions(spark, d), F.col("q") <= 25, "y", "p", "flag").select(r6("model"), r6("mean"), r6("group_mean"))


@R("A38_sample_size_percentiles", f"SELECT quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, round(avg((n < 3)::INT), 6) AS under_three FROM {_YEARS}")
def a38(spark, d):
    y = seasons(spark, d)
    q = quantiles(y, [], F.col("n"), [0.1, 0.5, 0.9])
    at = lambda k, n: F.get("quantiles", F.lit(k)).alias(n)
    return y.agg(r6(F.avg((F.col("n") < 3).cast("int")), "under_three")).crossJoin(F.broadcast(q)).select(at(0, "p10"), at(1, "p50"), at(2, "p90"), "under_three")


@R("A42_classification_eval", "SELECT count(*) AS n, round(avg((p = y)::INT), 6) AS accuracy, round(count_if(p = 1 AND y = 1) / count_if(y = 1)::DOUBLE, 6) AS positive_accuracy, round(count_if(p = 1 AND y = 0) / nullif(count_if(y = 0), 0)::DOUBLE, 6) AS false_positive_rate FROM (SELECT (n_chars > 500)::INT AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")
def a42(spark, d):
    rows = labelled(spark, d).select((F.col("n_chars") > 500).cast("int").alias("p"), F.col("quality").alias("y"))
    return E.classification_eval(rows, "p", "y").select("n", r6("accuracy"), r6("positive_accuracy"), r6("false_positive_rate"))


@R("A44_season_coverage_gaps", f"SELECT s.season, count(*) AS expected, count_if(y.o_custkey IS NULL) AS missing FROM customer CROSS JOIN (SELECT DISTINCT season FROM {_YEARS}) s LEFT JOIN {_YEARS} y ON y.o_custkey = c_custkey AND y.season = s.season GROUP BY 1")
def a44(spark, d):
    """Expected keys per season against those present: counts suffice, so keys and seasons are not crossed."""
    return B.coverage_gaps(seasons(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "season")


@R("T03_top_features", "SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(list_filter(list_transform(range(1, 5), lambda i: {'m': -embedding[i]::DOUBLE, 'n': 'f' || i}), lambda s: s.m < 0)), 1, 2), lambda s: s.n), ',') AS top FROM embeddings")
def t03(spark, d):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(topk.top_features(v, ["f1", "f2", "f3", "f4"], 2), ",").alias("top"))


@R("T04_value_drivers")
def t04(spark, d):
    """The two largest positive contributions to each predicted price."""
    li = table(spark, d, "lineitem")
    m = M.ridge_fit(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], alpha=1.0)
    c = F.transform(M.contributions(m), lambda x: F.struct((-x["value"]).alias("minus"), x["feature"].alias("feature")))
    return li.select(*LINE, F.array_join(F.transform(F.slice(F.array_sort(F.filter(c, lambda x: x["minus"] < 0)), 1, 2), lambda x: x["feature"]), ",").alias("drivers"))


@R("T06_top_impact", "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def t06(spark, d):
    return topk.top_n(table(spark, d, "supplier"), "s_nationkey", 3, F.desc("s_acctbal"), F.col("s_suppkey")).select("s_nationkey", "s_suppkey", "s_acctbal")


@R("T08_largest_gap_key", "SELECT o_custkey, arg_min(o_orderstatus, struct_pack(a := -n, b := o_orderstatus)) AS largest FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def t08(spark, d):
    return A.value_counts_map(table(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", topk.largest_key(F.col("counts")).alias("largest"))


@R("T09_scenario_compare", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey - b.n_regionkey AS margin, abs(a.n_regionkey - b.n_regionkey) <= 2 AS overlap, CASE WHEN a.n_regionkey > b.n_regionkey THEN 'a' WHEN b.n_regionkey > a.n_regionkey THEN 'b' ELSE 'tie' END AS preferred FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def t09(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("value"), (F.col("n_regionkey") - 1).alias("low"), (F.col("n_regionkey") + 1).alias("high"))
    pairs = n.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return E.scenario_compare(n, pairs, "n_nationkey").select("a", "b", "margin", "overlap", "preferred")


@R("U05_promote", "SELECT o_orderkey, o_custkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def u05(spark, d):
    snapshot = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(snapshot, "o_custkey").select("o_orderkey", "o_custkey", "c_acctbal")


@R("S12_upsert_partial", f"WITH {_SPLIT} SELECT coalesce(t.user_id, u.user_id) AS user_id, coalesce(t.event_type, u.event_type) AS event_type, coalesce(t.event_id, 0) AS event_id, coalesce(u.value, t.value) AS value FROM t FULL JOIN u ON t.user_id = u.user_id AND t.event_type = u.event_type")
def s12(spark, d):
    t, u = _split(spark, d)
    return E.upsert_partial(t, u, ["user_id", "event_type"], ["value"], {"event_id": 0})


@R("S15_payload", "SELECT c_custkey, '{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS payload FROM customer")
def s15(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.payload(nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("payload"))


@R("S17_ingest_fact", "SELECT count(*) AS n, count_if(s_suppkey IS NULL) AS unmatched, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + 5")
def s17(spark, d):
    dim = table(spark, d, "supplier").select((F.col("s_suppkey") - 5).cast("string").alias("key"), "s_suppkey")
    facts = E.ingest_fact(table(spark, d, "lineitem").withColumn("key", F.col("l_suppkey").cast("string")), {"l_quantity": "double"}, [(dim, "key")])
    return facts.agg(F.count("*").alias("n"), F.count_if(F.col("s_suppkey").isNull()).alias("unmatched"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@R("J14_fuzzy_initials", """WITH p AS (SELECT p_name, min(p_partkey) AS best, left(p_name, 1) || left(split_part(p_name, ' ', -1), 1) AS block FROM part GROUP BY 1),
n AS (SELECT best AS p_partkey, CASE best % 3 WHEN 0 THEN left(p_name, length(p_name) - 1) WHEN 1 THEN replace(p_name, 'e', 'i') ELSE 'z' || substr(p_name, 2) END AS name FROM p),
s AS (SELECT p_partkey, best, 1 - levenshtein(name, p_name) / greatest(length(name), length(p_name), 1)::DOUBLE AS score FROM n JOIN p ON block = left(name, 1) || left(split_part(name, ' ', -1), 1)),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, best))
SELECT p_partkey, best FROM r WHERE rn = 1 AND score >= 0.75 AND (score >= 1 OR score - coalesce(second, 0) >= 0.05)""")
def j14(spark, d):
    """Distinct names in altered spellings; members of other initials are never compared, so names with a wrong first letter find nothing."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("best"))
    kind = F.col("best") % 3
    name = F.when(kind == 0, F.left("p_name", F.length("p_name") - 1)).when(kind == 1, F.replace("p_name", F.lit("e"), F.lit("i"))).otherwise(F.concat(F.lit("z"), F.substring("p_name", 2, 10_000)))
    out = J.fuzzy_match(p.select(F.col("best").alias("p_partkey"), name.alias("name")), p, "p_partkey", "name", "best", "p_name", J.name_block(F.col("name")), J.name_block(F.col("p_name")))
    return out.where(F.col("best").isNotNull()).select("p_partkey", "best")


@R("J19_snapshot_members", "SELECT o_custkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN lineitem ON l_orderkey = o_orderkey WHERE r = 1")
def j19(spark, d):
    snapshots = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return B.snapshot_members(snapshots, table(spark, d, "lineitem"), "o_custkey", "l_orderkey", F.desc("o_orderdate"), F.desc("l_orderkey")).select("o_custkey", "l_partkey")


@R("J26_key_crosswalk", "SELECT n_nationkey, n_name AS canonical FROM nation")
def j26(spark, d):
    """One row per candidate field, normalised, joined; an unmatched row keeps its own name."""
    n = table(spark, d, "nation")
    fields = n.selectExpr("n_nationkey", "stack(2, 1, upper(n_name), 2, concat(' ', n_name)) as (place, field)").withColumn("key", S.normalize_name(F.col("field")))
    known = n.select(S.normalize_name(F.col("n_name")).alias("key"), F.col("n_name").alias("canonical"))
    best = fields.join(known, "key", "left").groupBy("n_nationkey").agg(F.min_by("canonical", "place").alias("canonical"), F.min("field").alias("field"))
    return best.select("n_nationkey", F.coalesce("canonical", "field").alias("canonical"))


@R("M11_season_covariates", f"WITH y AS {_YEARS} SELECT o_custkey, season, row_number() OVER w AS career_index, coalesce(season - lag(season) OVER w > 1, FALSE) AS gap, n - coalesce(lag(n) OVER w, n) AS change FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY season)")
def m11(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("season")
    y = W.career_index(seasons(spark, d), "o_custkey", "season")
    return y.select("o_custkey", "season", "career_index", F.coalesce(F.col("season") - F.lag("season").over(w) > 1, F.lit(False)).alias("gap"), (F.col("n") - F.coalesce(F.lag("n").over(w), F.col("n"))).alias("change"))


@R("M13_context_adjust", """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem) SELECT l_returnflag, round(avg(l_extendedprice - b * (l_quantity - m)), 2) AS adjusted FROM lineitem, s GROUP BY 1""")
def m13(spark, d):
    li = table(spark, d, "lineitem")
    return B.context_adjust(li, "l_extendedprice", ["l_quantity"]).groupBy("l_returnflag").agg(F.round(F.avg("adjusted"), 2).alias("adjusted"))


@R("M18_rolling_origin", """WITH x AS (SELECT year(o_orderdate) AS s, o_totalprice AS y FROM orders), f AS (SELECT unnest([1997, 1998, 1999]) AS fold), t AS (SELECT fold, avg(y) AS m FROM x JOIN f ON s < fold GROUP BY 1)
SELECT t.fold, count(*) AS n, round(sqrt(avg((y - m) * (y - m))), 2) AS rmse FROM x JOIN t ON s = fold GROUP BY 1""")
def m18(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("s"), F.col("o_totalprice").alias("y"))
    return E.rolling_origin_mean(rows, "s", "y", [1997, 1998, 1999]).select("fold", "n", F.round("rmse", 2).alias("rmse"))


@R("M19_grid_search", f"""WITH y AS (SELECT o_custkey, season, total / n AS raw, n::DOUBLE AS w FROM {_YEARS}), p AS (SELECT season, avg(raw) AS p FROM y GROUP BY 1), nx AS (SELECT o_custkey, season - 1 AS season, raw AS target FROM y), k AS (SELECT unnest([1.0, 4.0, 8.0, 16.0])::DOUBLE AS k)
SELECT k, round(sqrt(avg(pow(p + w / (w + k) * (raw - p) - target, 2))), 2) AS rmse FROM y JOIN p USING (season) JOIN nx USING (o_custkey, season), k GROUP BY 1""")
def m19(spark, d):
    y = seasons(spark, d).select("o_custkey", "season", (F.col("total") / F.col("n")).alias("raw"), F.col("n").cast("double").alias("w"))
    both = J.season_offset_join(y, y.select("o_custkey", "season", F.col("raw").alias("target")), ["o_custkey"], "season", 1)
    both = both.join(y.groupBy("season").agg(F.avg("raw").alias("p")), "season")
    grid = both.select("*", F.explode(F.array(*[F.lit(k) for k in (1.0, 4.0, 8.0, 16.0)])).alias("k"))
    e = F.col("p") + F.col("w") / (F.col("w") + F.col("k")) * (F.col("raw") - F.col("p")) - F.col("target")
    return grid.groupBy("k").agg(F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"))


@R("M27_champion_gate", f"""WITH RECURSIVE m AS (SELECT season, round(avg(total), 4) AS metric, row_number() OVER (ORDER BY season) AS k FROM {_YEARS} GROUP BY 1),
c AS (SELECT season, metric, k, TRUE AS promoted, metric AS best FROM m WHERE k = 1 UNION ALL SELECT m.season, m.metric, m.k, m.metric < 0.95 * c.best, CASE WHEN m.metric < 0.95 * c.best THEN m.metric ELSE c.best END FROM m JOIN c ON m.k = c.k + 1)
SELECT season, metric, promoted FROM c""")
def m27(spark, d):
    runs = seasons(spark, d).groupBy("season").agg(F.round(F.avg("total"), 4).alias("metric"))
    return E.champion_gate(runs, "season", "metric", 0.05).select("season", "metric", "promoted")


@R("X05_sessionize", """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) > 14400 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def x05(spark, d):
    return E.sessionize(table(spark, d, "events"), "user_id", "ts", "event_id", 14400, F.col("event_type") == "purchase").select("event_id", "user_id", "session")


@R("C13_recommend", """WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
c AS (SELECT c_nationkey, c_custkey, round(0.8 * least(greatest(c_acctbal / 100, 0), 100) + 0.2 * (least(greatest(coalesce(o_totalprice, 0) / 100000 - 2, -5), 5) + 5) / 10 * 100, 6) AS score FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1 WHERE c_acctbal >= 500)
SELECT c_nationkey, c_custkey, score, p::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS p FROM c) WHERE p <= 10""")
def c13(spark, d):
    """Latest row per candidate, floors, impact, weighted score, the ten best per school."""
    last = W.latest_per_key(table(spark, d, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    rows = E.threshold_filters(table(spark, d, "customer"), {}, {"c_acctbal": 500}).join(last, "c_custkey", "left")
    score = F.round(0.8 * S.clip(F.col("c_acctbal") / 100, 0.0, 100.0) + 0.2 * S.impact_fit(F.coalesce("o_totalprice", F.lit(0.0)) / 100000 - 2), 6)
    return topk.top_n(rows.withColumn("score", score), "c_nationkey", 10, F.desc("score"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "score", "place")
