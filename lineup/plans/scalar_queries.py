"""Scalar cleaning and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions import scalars as S
from lineup.operators import tables as B
from lineup.plans.base import Registry, r6, sql_score, table

R = Registry()


@R("P01_safe_cast", "SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END || c_nationkey AS INTEGER) AS n FROM customer")
def p01(spark, d):
    text = F.concat(F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.safe_cast(text, "int").alias("n"))


@R("P02_canonical_name", "SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'ALPHA' WHEN 'NATION_1' THEN 'BETA' ELSE n_name END AS name FROM nation")
def p02(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.canonical_name(F.col("n_name"), {"NATION_0": "ALPHA", "NATION_1": "BETA"}).alias("name"))


@R("P03_height_to_inches", "SELECT p_partkey, (5 + p_size % 3) * 12 + p_size % 12 AS inches FROM part")
def p03(spark, d):
    size = F.col("p_size")
    text = F.concat((size % 3 + 5).cast("string"), F.lit("-"), (size % 12).cast("string"))
    plain = F.when(F.col("p_partkey") % 2 == 0, text).otherwise(((size % 3 + 5) * 12 + size % 12).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.height_to_inches(plain).alias("inches"))


@R("P04_infer_position", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'PG' WHEN 'Brand#2' THEN 'C' ELSE CASE WHEN p_size + 60 <= 73 THEN 'PG' WHEN p_size + 60 <= 76 THEN 'SG' WHEN p_size + 60 <= 79 THEN 'SF' WHEN p_size + 60 <= 82 THEN 'PF' ELSE 'C' END END AS position FROM part")
def p04(spark, d):
    return table(spark, d, "part").select("p_partkey", S.infer_position(F.col("p_brand"), F.col("p_size") + 60, {"Brand#1": "PG", "Brand#2": "C"}).alias("position"))


@R("P05_share_of_total", "SELECT l_returnflag, l_linestatus, CASE WHEN a + b + c >= 1 THEN round(a / (a + b + c), 4) END AS share_a FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS a, count(*)::DOUBLE AS b, sum(l_linenumber)::DOUBLE AS c FROM lineitem GROUP BY 1, 2)")
def p05(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("a"), F.count("*").cast("double").alias("b"), F.sum("l_linenumber").cast("double").alias("c"))
    return g.select("l_returnflag", "l_linestatus", S.share_of_total([F.col("a"), F.col("b"), F.col("c")])[0].alias("share_a"))


@R("P06_parse_record", "SELECT n_nationkey, n_nationkey AS wins, n_regionkey AS losses FROM nation")
def p06(spark, d):
    wins, losses = S.parse_record(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", wins.alias("wins"), losses.alias("losses"))


@R("P07_season_label", "SELECT DISTINCT year(o_orderdate) AS season, (year(o_orderdate) - 1)::VARCHAR || '-' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS label, year(o_orderdate) AS back FROM orders")
def p07(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("season")).distinct().withColumn("label", S.season_label(F.col("season")))
    return rows.select("season", "label", S.parse_season(F.col("label")).alias("back"))


@R("P08_swap_last_first", "SELECT p_partkey, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS name FROM part")
def p08(spark, d):
    return table(spark, d, "part").select("p_partkey", S.swap_last_first(F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))).alias("name"))


@R("P09_normalize_name", "SELECT p_partkey, p_name AS name, left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1) AS initials FROM part")
def p09(spark, d):
    odd = F.concat(F.lit(" "), F.upper("p_name"), F.lit("  Jr."))
    return table(spark, d, "part").select("p_partkey", S.normalize_name(odd).alias("name"), S.initials(odd).alias("initials"))


@R("P11_stable_id", "SELECT c_custkey, (('0x' || left(sha256(c_name), 16))::UBIGINT % 9223372036854775808::UBIGINT)::BIGINT AS id FROM customer")
def p11(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.stable_id(F.col("c_name")).alias("id"))


@R("P12_minutes_from_share", "SELECT c_custkey, round(CASE WHEN c_acctbal % 3 < 1 THEN 12.5 ELSE greatest(c_acctbal / 100, 0) * 40 END, 6) AS minutes FROM customer")
def p12(spark, d):
    pct = F.when(F.col("c_acctbal") % 3 >= 1, F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", r6(S.minutes_from_share(F.when(F.col("c_acctbal") % 3 < 1, None).otherwise(F.col("c_acctbal")), F.lit(12.5)), "minutes"))


@R("P15_zone_bucket", """SELECT event_id, CASE WHEN dist <= 6 THEN 'rim' WHEN dist <= 20.75 THEN 'mid' WHEN abs(y) >= 22 THEN 'corner3' WHEN abs(y) < 8 THEN 'straight3' ELSE 'wing3' END AS zone
FROM (SELECT *, sqrt((abs(x) - 41.75) * (abs(x) - 41.75) + y * y) AS dist FROM (SELECT event_id, (event_id % 95 - 47)::DOUBLE AS x, (event_id % 49 - 24)::DOUBLE AS y FROM events))""")
def p15(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", S.zone_bucket((e % 95 - 47).cast("double"), (e % 49 - 24).cast("double")).alias("zone"))


@R("P21_clip_deltas", """WITH h AS (SELECT c_custkey, least(greatest(c_acctbal / 5000 - 1, -0.75), 0.75) AS a, least(greatest((c_custkey % 11) / 5.0 - 1, -0.5), 0.5) AS b FROM customer)
SELECT c_custkey, round(a * f, 6) AS a, round(b * f, 6) AS b FROM (SELECT *, CASE WHEN abs(a + b) > 1.0 THEN 1.0 / abs(a + b) ELSE 1 END AS f FROM h)""")
def p21(spark, d):
    a, b = S.clip_deltas([F.col("c_acctbal") / 5000 - 1, (F.col("c_custkey") % 11) / 5.0 - 1], [0.75, 0.5], 1.0)
    return table(spark, d, "customer").select("c_custkey", r6(a, "a"), r6(b, "b"))


@R("P22_piecewise_linear", "SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 20 THEN (p_size - 5) * (10.0 / 15) WHEN p_size <= 40 THEN 10 + (p_size - 20) * 0.5 ELSE 20 END, 6) AS y FROM part")
def p22(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.piecewise_linear(F.col("p_size"), [(5.0, 0.0), (20.0, 10.0), (40.0, 20.0)]), "y"))


@R("P27_range_match", "SELECT s_suppkey, round(greatest(0, 1 - abs(s_acctbal - m) / greatest(hi - lo, 0.1)) * 100, 6) AS fit FROM supplier, (SELECT avg(s_acctbal) AS m, max(s_acctbal) AS hi, min(s_acctbal) AS lo FROM supplier)")
def p27(spark, d):
    s = table(spark, d, "supplier")
    scale = s.agg(F.avg("s_acctbal").alias("m"), (F.max("s_acctbal") - F.min("s_acctbal")).alias("width"))  # one row
    return s.crossJoin(F.broadcast(scale)).select("s_suppkey", r6(S.range_match(F.col("s_acctbal"), F.col("m"), F.col("width"), 0.1), "fit"))


@R("P29_logit_sigmoid", "SELECT l_discount, round(ln(p / (1 - p)), 6) AS logit, round(p, 6) AS back FROM (SELECT DISTINCT l_discount, least(greatest(l_discount, 1e-6), 1 - 1e-6) AS p FROM lineitem)")
def p29(spark, d):
    x = S.logit(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_discount").distinct().select("l_discount", r6(x, "logit"), r6(S.sigmoid(x), "back"))


@R("P30_percentile_to_score", f"SELECT c_custkey, round({sql_score('((c_custkey % 1000) / 1000.0)::DOUBLE')}, 6) AS score FROM customer")
def p30(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(S.percentile_to_score((F.col("c_custkey") % 1000) / 1000.0), "score"))


@R("P31_shrink_weight", "SELECT p_partkey, round(CASE WHEN p_size + 8 > 0 THEN p_size / (8.0 + p_size) ELSE 0 END, 6) AS w FROM part")
def p31(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.shrink_weight(F.lit(8.0), F.col("p_size")), "w"))


@R("P35_impact_fit", "SELECT c_custkey, round((least(greatest(c_acctbal / 1000, -5), 5) + 5) / 10 * 100, 6) AS fit FROM customer")
def p35(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(S.impact_fit(F.col("c_acctbal") / 1000), "fit"))


@R("P36_json_get", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def p36(spark, d):
    return table(spark, d, "events").select("event_id", B.json_get_or_default(F.col("props"), "$.k", 0).alias("k"))


@R("P46_interval_probability", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN 1 / (1 + exp(-(l_quantity - 25) / (l_discount * 100))) ELSE (l_quantity >= 25)::INT::DOUBLE END, 6) AS p FROM lineitem")
def p46(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(S.interval_probability(F.col("l_quantity"), 25.0, F.col("l_discount") * 100), "p"))


@R("P58_tier_cut", "SELECT c_custkey, (1 + (c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 5000)::INT) AS tier FROM customer")
def p58(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.tier_cut(F.col("c_acctbal"), [0.0, 2500.0, 5000.0]).alias("tier"))


@R("P25_cosine_to_mean", """WITH m AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(least(greatest(100 * list_cosine_similarity(embedding::DOUBLE[], c), 0), 100), 6) AS fit FROM embeddings JOIN m USING (label)""")
def p25(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    mean = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return e.join(mean, "label").select("vec_id", r6(S.cosine_score(F.col("v"), F.col("c")), "fit"))


@R("P26_contributions_add_up", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) * 100, 6) AS total FROM embeddings")
def p26(spark, d):
    v = F.col("embedding").cast("array<double>")
    parts = S.cosine_contributions(v, F.reverse(v))
    return table(spark, d, "embeddings").select("vec_id", r6(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), "total"))


@R("S05_html_rows", r"SELECT page_id, len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def s05(spark, d):
    """Rows of a page cut out by patterns, as typed columns."""
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@R("P62_topic_gate", """SELECT page_id, CASE WHEN regexp_matches(url, '/(fr|de)/') THEN 'reject' WHEN regexp_matches(lower(html), 'class="ad"') THEN 'mixed' ELSE 'keep' END AS verdict FROM pages""")
def p62(spark, d):
    """Ordered rules over url and text: the first that holds decides."""
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").rlike("/(fr|de)/"), "reject").when(F.lower("html").rlike('class="ad"'), "mixed").otherwise("keep").alias("verdict"))


@R("P63_classify_event", """SELECT page_id, CASE WHEN t THEN 'the' WHEN b THEN 'und' ELSE 'none' END AS event, CASE WHEN t THEN 0.9 WHEN b THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence
FROM (SELECT page_id, regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '(^|[ .,])the([ .,]|$)') AS t, regexp_matches(lower(html), '(^|[ .,])und([ .,]|$)') AS b FROM pages)""")
def p63(spark, d):
    """Candidates with confidences by where a pattern stands; the most confident wins."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    found = F.array_compact(F.array(F.when(title.rlike("(^|[ .,])the([ .,]|$)"), F.struct(F.lit(0.9).alias("confidence"), F.lit("the").alias("event"))), F.when(F.lower("html").rlike("(^|[ .,])und([ .,]|$)"), F.struct(F.lit(0.7).alias("confidence"), F.lit("und").alias("event")))))
    best = F.coalesce(F.array_max(found), F.struct(F.lit(0.0).alias("confidence"), F.lit("none").alias("event")))
    return table(spark, d, "pages").select("page_id", best["event"].alias("event"), best["confidence"].alias("confidence"))
