"""Join, set and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import joins as J
from lineup.operators import sets as U
from lineup.operators import tables as B
from lineup.plans.base import Registry, r6, table
from lineup.plans.window_queries import _YEARS, seasons

R = Registry()


@R("J01_enrich", """SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j01(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    rows = J.enrich(table(spark, d, "orders"), (c, ["o_custkey"]), (n, ["n_nationkey"]), (table(spark, d, "region"), ["r_regionkey"]))
    return rows.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@R("J02_inner_gate", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') USING (l_partkey, l_suppkey) WHERE l_returnflag = 'A'")
def j02(spark, d):
    li = table(spark, d, "lineitem")
    pairs = lambda f: li.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct()
    return J.inner_gate(pairs("A"), pairs("R"), ["l_partkey", "l_suppkey"])


@R("J03_season_offset_join", f"WITH y AS {_YEARS} SELECT a.o_custkey, a.season, a.total AS total, b.total AS next_total FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.season = a.season + 1")
def j03(spark, d):
    y = seasons(spark, d).select("o_custkey", "season", "total")
    return J.season_offset_join(y, y.withColumnRenamed("total", "next_total"), ["o_custkey"], "season", 1)


@R("J04_latest_row_join", """SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""")
def j04(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.latest_row_join(table(spark, d, "customer"), o, "c_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey", "o_orderdate")


@R("J06_all_pairs_fit", "SELECT a.vec_id AS vec_id, b.vec_id AS target_id, round(least(greatest(100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 100), 6) AS fit FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) b ON a.label = b.label")
def j06(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("t")).select("label", F.col("t.vec_id").alias("target_id"), F.col("t.v").alias("w"))
    return J.all_pairs_fit(e, first, "label", "v", "w").select("vec_id", "target_id", r6("fit"))


@R("J07_semi_members", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j07(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return J.semi_members(table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


@R("J08_anti_departed", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def j08(spark, d):
    gone = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    covered = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return J.anti_departed(table(spark, d, "customer"), gone, ["c_custkey"], covered, ["c_nationkey"]).select("c_custkey", "c_nationkey")


@R("J09_two_role_join", """SELECT DISTINCT l_suppkey, l_partkey, a.s_nationkey AS own_s_nationkey, b.s_nationkey AS other_s_nationkey FROM lineitem LEFT JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey = l_partkey""")
def j09(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return J.two_role_join(rows, table(spark, d, "supplier"), "s_suppkey", "l_suppkey", "l_partkey", ["s_nationkey"])


@R("J10_exact_key_join", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0) GROUP BY 1, 2")
def j10(spark, d):
    li = table(spark, d, "lineitem")
    keys = li.where("l_tax = 0").select("l_orderkey", "l_linenumber").distinct()
    return li.join(keys, ["l_orderkey", "l_linenumber"], "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@R("J11_history_counts", f"SELECT o_custkey, season, row_number() OVER (PARTITION BY o_custkey ORDER BY season) - 1 AS prior_seasons, min(season) OVER (PARTITION BY o_custkey) AS first_season FROM {_YEARS}")
def j11(spark, d):
    return J.history_counts(seasons(spark, d), "o_custkey", "season")


_FUZZY = """WITH n AS (SELECT s_suppkey AS name_id, 'Supplier#' || lpad((s_suppkey * 7 % 100)::VARCHAR, 9, '0') || CASE WHEN s_suppkey % 4 = 0 THEN 'xy' ELSE '' END AS name, s_nationkey AS b FROM supplier),
s AS (SELECT name_id, s_suppkey, 1 - levenshtein(name, s_name) / greatest(length(name), length(s_name), 1)::DOUBLE AS score FROM n LEFT JOIN supplier ON s_nationkey = b),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY name_id ORDER BY score DESC NULLS LAST, s_suppkey)),
t AS (SELECT *, CASE WHEN score IS NULL OR score < 0.75 THEN 'unmatched' WHEN score < 1 AND score - coalesce(second, 0) < 0.05 THEN 'ambiguous' WHEN score >= 0.82 THEN 'matched' ELSE 'relaxed' END AS status FROM r WHERE rn = 1)"""


def _names(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") * 7 % 100).cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 4 == 0, "xy").otherwise(""))
    return s.select(F.col("s_suppkey").alias("name_id"), name.alias("name"), F.col("s_nationkey").alias("b")), s


@R("J12_fuzzy_match", _FUZZY + "SELECT name_id, CASE WHEN status IN ('matched', 'relaxed') THEN s_suppkey END AS s_suppkey, CASE WHEN score >= 0.75 THEN round(score, 6) END AS score, status FROM t")
def j12(spark, d):
    names, s = _names(spark, d)
    return J.fuzzy_match(names, s, "name_id", "name", "s_suppkey", "s_name", F.col("b"), F.col("s_nationkey")).select("name_id", "s_suppkey", r6("score"), "status")


@R("A43_match_rate_report", _FUZZY + "SELECT status, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM t GROUP BY 1")
def a43(spark, d):
    from lineup.operators.aggregates import status_report

    names, s = _names(spark, d)
    return status_report(J.fuzzy_match(names, s, "name_id", "name", "s_suppkey", "s_name", F.col("b"), F.col("s_nationkey")), "status").select("status", "n", r6("share"))


@R("J17_outer_merge_many", "SELECT o_custkey, year(o_orderdate) AS season, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY 1, 2")
def j17(spark, d):
    """Per-status frames merged by one pivot of their long form: one shuffle in place of chained outer joins."""
    rows = B.outer_merge_many(table(spark, d, "orders"), ["o_custkey", F.year("o_orderdate").alias("season")], "o_orderstatus", ["F", "O", "P"], F.count("o_orderkey"))
    return rows.select("o_custkey", "season", *[F.nullif(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@R("J18_knn", """WITH p AS (SELECT t.vec_id AS target, e.vec_id, list_distance(t.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) t ON e.vec_id <> t.vec_id)
SELECT target, vec_id, round(distance, 6) AS distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, vec_id) AS place FROM p) WHERE place <= 3""")
def j18(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    targets = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("t")).select("t.*")
    return J.knn(e, targets, "vec_id", "v", 3).select("target", "vec_id", r6("distance"), "place")


@R("J20_next_period_membership", f"""WITH y AS {_YEARS} SELECT a.o_custkey, a.season, CASE WHEN b.o_custkey IS NULL THEN 'new' WHEN b.n = a.n THEN 'returning' ELSE 'transfer_in' END AS status FROM (SELECT * FROM y WHERE season = 1998) a LEFT JOIN (SELECT * FROM y WHERE season = 1997) b USING (o_custkey)""")
def j20(spark, d):
    y = seasons(spark, d)
    now, before = y.where("season = 1998").select("o_custkey", "season", "n"), y.where("season = 1997").select("o_custkey", "n")
    return J.next_period_status(now, before, "o_custkey", "n").select("o_custkey", "season", "status")


@R("J23_attach_comps", """WITH l AS (SELECT c_nationkey AS cell, year(o_orderdate) AS s, o_orderkey AS item FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, s ORDER BY item) AS r FROM l) WHERE r <= 3), c AS (SELECT DISTINCT cell, s FROM l)
SELECT c.cell, c.s AS season, coalesce(array_to_string((SELECT list(item ORDER BY s2 DESC, item) FROM (SELECT item, k.s AS s2 FROM k WHERE k.cell = c.cell AND k.s < c.s ORDER BY k.s DESC, item LIMIT 3)), ','), '') AS comps FROM c""")
def j23(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    rows = table(spark, d, "orders").join(c, "o_custkey").select("cell", F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("item"))
    out = J.attach_comps(rows.select("cell", "season").distinct(), rows, ["cell"], "season", "item")
    return out.select("cell", "season", F.concat_ws(",", F.transform("comps", lambda x: x.cast("string"))).alias("comps"))


@R("U01_departure_pairs", "SELECT o_custkey AS id, 1 AS kind FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey, 1 FROM customer WHERE c_acctbal < 0 UNION SELECT user_id, 1 FROM events WHERE event_type = 'error'")
def u01(spark, d):
    one = F.lit(1).alias("kind")
    return U.departure_pairs(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), one), table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), one), table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), one))


@R("U02_membership_union", """SELECT id, arg_min(source, p) AS source FROM (SELECT DISTINCT user_id AS id, 'events' AS source, 0 AS p FROM events UNION ALL SELECT DISTINCT o_custkey, 'orders', 1 FROM orders UNION ALL SELECT c_custkey, 'customer', 2 FROM customer) GROUP BY 1""")
def u02(spark, d):
    return U.membership_union([("events", table(spark, d, "events").select(F.col("user_id").alias("id"))), ("orders", table(spark, d, "orders").select(F.col("o_custkey").alias("id"))), ("customer", table(spark, d, "customer").select(F.col("c_custkey").alias("id")))], ["id"]).select("id", "source")


@R("U03_merge_lifecycle", """SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'F' END AS o_orderstatus, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1""")
def u03(spark, d):
    return U.merge_lifecycle(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["O", "P", "F"], ["o_orderdate"])


@R("U04_roster_diff", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'departed' WHEN a.o_custkey IS NULL THEN 'joined' ELSE 'stayed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def u04(spark, d):
    o = table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    return U.roster_diff(o.where("season = 1996"), o.where("season = 1997"), ["o_custkey"])


_SPLIT = "t AS (SELECT user_id, event_type, max(event_id) AS event_id, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), u AS (SELECT user_id, event_type, max(event_id) AS event_id, max(CASE WHEN event_id % 3 > 0 THEN value END) AS value FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1, 2)"


def _split(spark, d):
    e = table(spark, d, "events")
    t = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"))
    u = e.where("event_id % 2 = 1 and user_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("event_id") % 3 > 0, F.col("value"))).alias("value"))
    return t, u


@R("S10_upsert", f"WITH {_SPLIT} SELECT * FROM u UNION ALL SELECT * FROM t WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM u)")
def s10(spark, d):
    t, u = _split(spark, d)
    return U.upsert(t, u, ["user_id", "event_type"], F.desc("event_id"))


@R("S11_upsert_coalesce", f"WITH {_SPLIT} SELECT coalesce(t.user_id, u.user_id) AS user_id, coalesce(t.event_type, u.event_type) AS event_type, coalesce(t.event_id, u.event_id) AS event_id, coalesce(u.value, t.value) AS value FROM t FULL JOIN u ON t.user_id = u.user_id AND t.event_type = u.event_type")
def s11(spark, d):
    t, u = _split(spark, d)
    return U.upsert_coalesce(t, u, ["user_id", "event_type"], ["event_id"])


@R("S13_purge_stale_versions", "SELECT p_partkey, p_brand FROM part WHERE NOT (p_brand LIKE 'Brand#1%' AND p_brand <> 'Brand#13')")
def s13(spark, d):
    return U.purge_stale_versions(table(spark, d, "part"), "p_brand", "Brand#1", "Brand#13").select("p_partkey", "p_brand")


@R("S14_unexpired", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def s14(spark, d):
    return B.unexpired(table(spark, d, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@R("X01_dedup_window", """SELECT user_id, event_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, ts, event_id) AS r FROM (SELECT *, floor(date_diff('day', DATE '2020-01-01', ts::DATE) / 14)::BIGINT AS bucket FROM events)) WHERE r = 1""")
def x01(spark, d):
    return U.dedup_window(table(spark, d, "events"), "user_id", "ts", "value", "event_id").select("user_id", "event_id", "bucket")


@R("X02_monotone_flag", "SELECT c_custkey, c_acctbal > 9000 OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup') AS available FROM customer")
def x02(spark, d):
    """A flag that only turns on: what was on stays on."""
    seen = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return table(spark, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", ((F.col("c_acctbal") > 9000) | F.coalesce("seen", F.lit(False))).alias("available"))
