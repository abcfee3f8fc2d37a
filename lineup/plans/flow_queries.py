"""Sources, feeds and composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.functions import fit as N
from lineup.functions import playing as P
from lineup.functions import scalars as S
from lineup.functions import text as X
from lineup.operators import aggregates as A
from lineup.operators import extras as E
from lineup.operators import joins as J
from lineup.operators import models as M
from lineup.operators import sets as U
from lineup.operators import tables as B
from lineup.operators import topk
from lineup.operators import windows as W
from lineup.plans.aggregate_queries import _LABELLED, labelled
from lineup.plans.base import Registry, r6, table
from lineup.plans.window_queries import _YEARS, seasons
from lineup.sources import io
from lineup.streaming import feeds

R = Registry()


@R("S01_read_pbp", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS props, NULL::DOUBLE AS clock FROM events")
def s01(spark, d):
    """Two seasons' files, of which one lacks a column, and a column that neither has."""
    e, folder = table(spark, d, "events"), io.new_folder(spark, "seasons")
    e.where("event_id % 2 = 0").select("event_id", "props").write.parquet(f"{folder}/new")
    e.where("event_id % 2 = 1").select("event_id").write.parquet(f"{folder}/old")
    return io.read_tolerant(spark, [f"{folder}/new", f"{folder}/old"], {"clock": "double"}).select("event_id", "props", "clock")


@R("S02_read_positional", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::VARCHAR AS ext_2, c_mktsegment AS ext_3 FROM customer")
def s02(spark, d):
    folder = io.new_folder(spark, "positional")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(f"{folder}/rows")
    return io.read_positional(spark, f"{folder}/rows", ["id", "name"], 4)


@R("S03_read_wide_csv", "SELECT p_partkey::VARCHAR AS id, p_size::VARCHAR AS size, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand FROM part")
def s03(spark, d):
    """Three files' folders: one has its columns in another order, one has no brands."""
    folder = io.new_folder(spark, "wide")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("off.stats[0]"), F.col("p_brand").alias("def.brand"))
    for k, columns in enumerate((["id", "off.stats[0]"], ["def.brand", "id", "off.stats[0]"], ["id", "off.stats[0]", "def.brand"])):
        p.where(F.col("id") % 3 == k).select(*[f"`{c}`" for c in columns]).write.option("header", True).csv(f"{folder}/{k}")
    got = io.read_wide_csv(spark, [f"{folder}/{k}" for k in range(3)], {"off.stats[0]": "size", "def.brand": "brand"})
    return got.select("id", "size", "brand")


@R("S04_extract_embedded_json", "SELECT l_orderkey AS page, l_partkey AS part, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS line, [l_suppkey, l_linenumber] AS keys, 'a ]; \"' || l_returnflag || '\" \\ undefined {' AS note FROM lineitem")
def s04(spark, d):
    """Pages that hold an order's lines as an array of objects in a script: nested arrays, brackets, quotes and line ends in strings, undefined fields."""
    li = table(spark, d, "lineitem")
    line = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber").cast("string")).otherwise("undefined")
    note = F.concat(F.lit('"a ]; \\"'), "l_returnflag", F.lit('\\" \\\\ undefined {"'))
    record = F.concat(F.lit('{"part": '), "l_partkey", F.lit(', "line":'), line, F.lit(',\n"keys": ['), "l_suppkey", F.lit(", "), "l_linenumber", F.lit('], "note": '), note, F.lit("}"))
    pages = li.groupBy("l_orderkey").agg(F.concat(F.lit("<html><script>state = ["), F.array_join(F.collect_list(record), ",\n"), F.lit("]; other = [1];</script></html>")).alias("html"))
    got = io.extract_embedded_json(pages, "html", "state =", "struct<part:bigint,line:int,keys:array<bigint>,note:string>")
    return got.select(F.col("l_orderkey").alias("page"), "record.*")


@R("S06_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000")
def s06(spark, d):
    return io.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], {"o_orderstatus": ["F", "P"]}, {"o_totalprice": 100000})


@R("S07_write_features", f"SELECT season, count(*) AS n, round(sum(total), 2) AS total FROM {_YEARS} GROUP BY 1")
def s07(spark, d):
    """Written by season, read back by season."""
    folder = io.new_folder(spark, "features")
    io.write_features(seasons(spark, d), f"{folder}/t")
    return spark.read.parquet(f"{folder}/t").groupBy("season").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@R("S08_memo", f"SELECT 'a' AS mode, count(*) AS n FROM {_YEARS} UNION ALL SELECT 'b', count(*) FROM orders")
def s08(spark, d):
    """Two results under different parts of a key; the second look-up of the first reads what is there."""
    folder = io.new_folder(spark, "memo")
    make = {"a": lambda: seasons(spark, d).select(F.col("o_custkey").alias("k")), "b": lambda: table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))}
    for m in ("a", "b"):
        io.memo(spark, folder, {"mode": m, "data": d}, make[m])
    read = lambda m: io.memo(spark, folder, {"mode": m, "data": d}, make["b" if m == "a" else "a"]).agg(F.lit(m).alias("mode"), F.count("*").alias("n"))
    return read("a").unionByName(read("b"))


@R("S16_stage", f"WITH y AS {_YEARS} SELECT a.o_custkey, a.season, a.total, b.best FROM y a JOIN (SELECT o_custkey, max(total) AS best FROM y GROUP BY 1) b USING (o_custkey)")
def s16(spark, d):
    """One staged table read twice."""
    y = io.stage(seasons(spark, d), "seasons")
    return y.join(y.groupBy("o_custkey").agg(F.max("total").alias("best")), "o_custkey").select("o_custkey", "season", "total", "best")


_XY = "(l_quantity - 25) * 2 AS x, (l_partkey % 61) - 30.0 AS y"


@R("P16_zone_bucket", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r <= 6 THEN 'rim' WHEN r <= 20.75 THEN 'mid' WHEN abs(y) >= 22 THEN 'corner3' WHEN abs(y) < 8 THEN 'straight3' ELSE 'wing3' END AS zone FROM (SELECT *, sqrt((abs(x) - 41.75) ** 2 + y * y) AS r FROM (SELECT *, {_XY} FROM lineitem))")
def p16(spark, d):
    x, y = (F.col("l_quantity") - 25) * 2, (F.col("l_partkey") % 61) - 30.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.zone_bucket(x, y).alias("zone"))


_FOLD = "SELECT o_custkey, max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS s, min(o_orderdate) AS o_orderdate FROM orders WHERE o_orderkey % 2 = {} GROUP BY 1"


def _lifecycle(spark, d, name):
    """Orders in two batches through the sink's function; the target is a new table for each batch."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    target = [io.stage(o.limit(0).select("o_custkey", "o_orderstatus", "o_orderdate"), name)]
    sink = feeds.lifecycle_sink(lambda: target[0], lambda df: target.__setitem__(0, io.stage(df, name)), ["o_custkey"], "o_orderstatus", ["O", "P", "F"], ["o_orderdate"])
    for k in (0, 1):
        sink(o.where(F.col("o_orderkey") % 2 == k), k)
    return target[0]


@R("X03_incremental_lifecycle", f"WITH a AS ({_FOLD.format(0)}), b AS ({_FOLD.format(1)}) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE coalesce(b.s, a.s) WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'F' END AS o_orderstatus, coalesce(a.o_orderdate, b.o_orderdate) AS o_orderdate FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def x03(spark, d):
    return _lifecycle(spark, d, "lifecycle")


@R("X07_late_update", "WITH t AS (SELECT user_id, event_type, min(CASE WHEN event_id % 3 > 0 THEN ts END) AS first FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), u AS (SELECT user_id, event_type, min(ts) AS first FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT coalesce(t.user_id, u.user_id) AS user_id, coalesce(t.event_type, u.event_type) AS event_type, epoch_us(coalesce(t.first, u.first)) AS first FROM t FULL JOIN u ON t.user_id = u.user_id AND t.event_type = u.event_type")
def x07(spark, d):
    """Later rows fill dates that are missing and erase none."""
    e = table(spark, d, "events").withColumn("first", F.unix_micros(F.col("ts").cast("timestamp")))
    t = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min(F.when(F.col("event_id") % 3 > 0, F.col("first"))).alias("first"))
    u = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.min("first").alias("first"))
    return U.upsert_coalesce(t, u, ["user_id", "event_type"], ["first"])


@R("X04_propagate_staleness", "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 20) AS stale FROM customer")
def x04(spark, d):
    """Profiles whose user had an error are stale, until a signup rebuilds them."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return feeds.propagate_staleness(e, table(spark, d, "customer").select("c_custkey"), "c_custkey", F.col("event_type") == "error", e.where("event_type = 'signup' and value > 20"))


_URLS, _TEXTS = {"womens": "/fr/", "football": "/de/", "wanted": "/en/"}, {"womens": "(?i)class=.ad.", "other": "(?i)shutterstock|cookie", "wanted": "(?i)\\bthe\\b"}
_NEWS = {"link": "href=.https?://[a-z]*\\.?[a-m]", "list": "<li>", "heading": "<h[12]"}
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_GATE = f"""g AS (SELECT page_id, url, {_TITLE} AS title, html, concat_ws(' ', {_TITLE}, html, url) AS blob FROM pages),
v AS (SELECT *, CASE WHEN contains(url, '/fr/') THEN 'womens_url' WHEN regexp_matches(blob, 'class=.ad.', 'i') THEN 'womens_text:' || regexp_extract(blob, 'class=.ad.', 0, 'i') WHEN contains(url, '/de/') AND (contains(url, '/en/') OR regexp_matches(blob, '\\bthe\\b', 'i')) THEN 'conflicting_signals' WHEN contains(url, '/de/') THEN 'football_url'
  WHEN regexp_matches(blob, 'shutterstock|cookie', 'i') AND NOT (contains(url, '/en/') OR regexp_matches(blob, '\\bthe\\b', 'i')) THEN 'other_text:' || regexp_extract(blob, 'shutterstock|cookie', 0, 'i') END AS reason FROM g),
k AS (SELECT *, CASE WHEN regexp_matches(lower(title), '<h[12]') THEN 0.8 WHEN regexp_matches(lower(html), '<h[12]') THEN 0.6 ELSE 0 END AS h, CASE WHEN regexp_matches(lower(html), '<li>') THEN 0.7 ELSE 0 END AS l, CASE WHEN regexp_matches(lower(html), 'href=.https?://[a-z]*\\.?[a-m]') THEN 0.7 ELSE 0 END AS n FROM v),
c AS (SELECT *, greatest(h, l, n)::DOUBLE AS confidence, CASE WHEN greatest(h, l, n) = 0 THEN 'unknown' WHEN n = greatest(h, l, n) THEN 'link' WHEN l = greatest(h, l, n) THEN 'list' ELSE 'heading' END AS event FROM k)"""


def _gate():
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return X.topic_gate(F.col("url"), title, F.col("html"), _URLS, _TEXTS), X.classify_event(title, F.col("html"), _NEWS, ("link", "list"))


@R("P62b_topic_gate", f"WITH {_GATE} SELECT page_id, reason IS NULL AS kept, reason FROM v")
def p62b(spark, d):
    """The whole rule chain with signals that pages have."""
    return table(spark, d, "pages").select("page_id", _gate()[0].alias("g")).select("page_id", "g.kept", "g.reason")


@R("P63b_classify_event", f"WITH {_GATE} SELECT page_id, event, confidence, confidence >= 0.5 AS above FROM c")
def p63b(spark, d):
    return table(spark, d, "pages").select("page_id", _gate()[1].alias("e")).select("page_id", "e.event", "e.confidence", "e.above")


@R("X06_classify_stream", f"WITH {_GATE} SELECT 'log' AS sink, count(*) AS rows, sum(page_id)::BIGINT AS ids FROM c UNION ALL SELECT 'staging', count(*), sum(page_id)::BIGINT FROM c WHERE reason IS NULL AND event <> 'unknown' UNION ALL SELECT 'canonical', count(*), sum(page_id)::BIGINT FROM c WHERE reason IS NULL AND event <> 'unknown' AND confidence >= 0.65")
def x06(spark, d):
    """Pages as a stream through the three sinks; what each holds at the end."""
    folder = io.new_folder(spark, "news")
    pages = table(spark, d, "pages")
    pages.select("page_id", "url", "html").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pages.select("page_id", "url", "html").schema).parquet(f"{folder}/in")
    gate, event = _gate()
    sink = feeds.classify_sink(gate, event, lambda name, df: df.select("page_id").write.mode("append").parquet(f"{folder}/{name}"), 0.65)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    held = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("sink"), F.count("*").alias("rows"), F.sum("page_id").alias("ids")) for n in ("log", "staging", "canonical")]
    return held[0].unionByName(held[1]).unionByName(held[2])


@R("M07b_project_value", "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, var_pop(l_extendedprice) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + b * l_quantity, 4) AS value, round(a + b * l_quantity - 1.2816 * sqrt((1 - r2) * v + b * b * l_tax), 3) AS low, round(a + b * l_quantity + 1.2816 * sqrt((1 - r2) * v + b * b * l_tax), 3) AS high FROM lineitem, s")
def m07b(spark, d):
    """Prediction and 80 % interval: residual variance and the feature's own variance."""
    li = table(spark, d, "lineitem")
    v, low, high = M.predict_interval(M.ridge_fit(li, "l_extendedprice", ["l_quantity"]), {"l_quantity": F.col("l_tax")}, P.Z80)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(v, 4).alias("value"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


_PARTS = ", ".join(f"c_acctbal / 1000 + c_custkey % {k} AS c{k}" for k in (7, 11, 13))


@R("T02b_explain_two_stage", f"""WITH x AS (SELECT c_nationkey, c_custkey, {_PARTS} FROM customer), s AS (SELECT *, 0.5 * c7 + 0.3 * c11 + 0.2 * c13 AS s1, c13 AS s2 FROM x), a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s1 DESC, c_custkey) AS p1 FROM s),
b AS (SELECT *, CASE WHEN p1 <= 20 THEN row_number() OVER (PARTITION BY c_nationkey, p1 <= 20 ORDER BY CASE WHEN p1 <= 20 THEN s2 END DESC, c_custkey) END AS p2 FROM a)
SELECT c_nationkey, c_custkey, p1::INT AS place1, p2::INT AS place2, CASE WHEN p1 > 20 THEN 'top_20_excluded' WHEN p2 > 5 THEN 'top_5_excluded' ELSE 'selected' END AS stage, CASE WHEN 0.2 * c13 <= least(0.5 * c7, 0.3 * c11) THEN 'c13' WHEN 0.3 * c11 <= 0.5 * c7 THEN 'c11' ELSE 'c7' END AS weakest, round(s1 - min(CASE WHEN p1 <= 20 THEN s1 END) OVER (PARTITION BY c_nationkey), 6) AS margin1 FROM b""")
def t02b(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", *[(F.col("c_acctbal") / 1000 + F.col("c_custkey") % k).alias(f"c{k}") for k in (7, 11, 13)])
    got = topk.explain_two_stage(c, "c_nationkey", "c_custkey", {"c7": 0.5, "c11": 0.3, "c13": 0.2}, F.col("c13"), 20, 5)
    return got.select("c_nationkey", "c_custkey", "place1", "place2", "stage", "weakest", r6("margin1"))


@R("M21b_fit_offset_beta", """WITH x AS (SELECT quality::DOUBLE AS y, n_chars / 10000.0 AS x FROM documents d JOIN labels l ON l.doc_id = d.doc_id), g AS (SELECT unnest(range(-5000, 1))::DOUBLE / 1000 AS beta),
p AS (SELECT beta, y, least(greatest(1 / (1 + exp(-(1.5 + beta * x))), 1e-9), 1 - 1e-9) AS p FROM x, g), n AS (SELECT beta, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) + 0.25 * beta * beta AS nll FROM p GROUP BY 1)
SELECT CASE WHEN abs(b) < 0.01 THEN 0 ELSE round(b, 1) END::DOUBLE AS beta FROM (SELECT arg_min(beta, nll) AS b FROM n)""")
def m21b(spark, d):
    """The arg-min itself, to one decimal."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10000.0).alias("x"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("quality").cast("double").alias("y"), "x", F.lit(1.5).alias("offset"))
    return spark.range(1).select(F.round(F.lit(float(M.fit_offset_beta(rows, "y", "offset", "x"))), 1).alias("beta"))


@R("U05b_promote", "WITH n AS (SELECT o_custkey, max(o_orderdate) AS o_orderdate, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1), t AS (SELECT c_custkey AS o_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(t.o_custkey, n.o_custkey) AS o_custkey, t.c_acctbal, n.o_orderstatus, epoch_us(n.o_orderdate) AS seen FROM t FULL JOIN n ON n.o_custkey = t.o_custkey")
def u05b(spark, d):
    """Events that qualify are promoted into the canonical table: known rows are filled in, new ones come in."""
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'P')")
    new = W.latest_per_key(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", F.lit(None).cast("double").alias("c_acctbal"), "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seen"))
    held = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("bigint").alias("seen"))
    return U.upsert_coalesce(held, new, ["o_custkey"], ["c_acctbal"])


_KINDS = ["click", "error", "purchase", "signup", "view"]
_SEG = "s AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS seg FROM (SELECT *, coalesce(lag(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS ends FROM events)), g AS (SELECT user_id, seg, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS secs, count(*) AS n FROM s GROUP BY 1, 2)"


def _segments(spark, d):
    s = W.segment_id(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return s.groupBy("user_id", "segment_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("secs"), F.count("*").alias("n"))


@R("C01_team_pbp_features", f"WITH {_SEG}, a AS (SELECT user_id, count(*) AS events, {', '.join(f"round(avg((event_type = '{k}')::INT), 6) AS share_{k}" for k in _KINDS)}, round(count_if(event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1), b AS (SELECT user_id, count(*) AS segments, round(avg(secs), 6) AS mean_seconds, round(avg((secs <= 7200)::INT), 6) AS quick_rate FROM g GROUP BY 1) SELECT a.*, segments, mean_seconds, quick_rate FROM a JOIN b USING (user_id)")
def c01(spark, d):
    """Class shares, event rates, segments with their durations and the quick ones, per actor group."""
    e = table(spark, d, "events")
    shares = A.shot_profile(e, "user_id", "event_type", _KINDS).select("user_id", F.col("n").alias("events"), *[r6(f"share_{k}") for k in _KINDS], r6("share_error", "error_rate"))
    seg = _segments(spark, d).groupBy("user_id").agg(F.count("*").alias("segments"), r6(F.avg("secs"), "mean_seconds"), r6(F.avg((F.col("secs") <= 7200).cast("int")), "quick_rate"))
    return shares.join(seg, "user_id")


@R("C02_player_pbp_features", "WITH m AS (SELECT user_id, arg_min(event_type, (-c, event_type)) AS mode FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT e.user_id, any_value(m.mode) AS mode, count(*) AS attempts, round(count_if(event_type = 'purchase') / nullif(count_if(event_type = 'view'), 0), 6) AS rate, round(avg(value) FILTER (ts >= last - INTERVAL 2 DAY), 6) AS late_value, count(DISTINCT CAST(ts AS DATE)) AS games FROM events e JOIN m USING (user_id) JOIN l USING (user_id) GROUP BY 1")
def c02(spark, d):
    """Per actor: commonest class, attempts, rate, value near the end, days."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    n = lambda k: F.count_if(F.col("event_type") == k)
    late = F.when(F.col("ts") >= F.col("last") - F.expr("INTERVAL 2 DAYS"), F.col("value"))
    per = e.join(last, "user_id").groupBy("user_id").agg(F.count("*").alias("attempts"), r6(n("purchase") / F.nullif(n("view"), F.lit(0)), "rate"), r6(F.avg(late), "late_value"), F.countDistinct(F.to_date("ts")).alias("games"))
    return per.join(A.mode_by(e, "user_id", "event_type").select("user_id", "mode"), "user_id")


@R("C03_feature_tables", "WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice * o_orderkey) / sum(o_orderkey) AS mean FROM orders GROUP BY 1), x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, mean, n FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_nationkey >= 2), g AS (SELECT c_nationkey, quantile_cont(bal, 0.5) AS b, quantile_cont(mean, 0.5) AS m FROM x GROUP BY 1) SELECT c_custkey, round(coalesce(bal, b), 4) AS bal, round(coalesce(mean, m), 4) AS mean, (bal IS NULL)::INT + (mean IS NULL)::INT AS missing_count FROM x JOIN g USING (c_nationkey) WHERE coalesce(n, 0) >= 2")
def c03(spark, d):
    """Enriched, gated, imputed by group: a feature table."""
    o = A.weighted_mean(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "mean")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = J.enrich(table(spark, d, "customer"), (o, ["c_custkey"]), (n, ["c_custkey"])).where("c_nationkey >= 2")
    x = x.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"), "mean", "n")
    return A.median_impute(x, "c_nationkey", ["bal", "mean"]).where("n >= 2").select("c_custkey", F.round("bal", 4).alias("bal"), F.round("mean", 4).alias("mean"), "missing_count")


_DEST = f"""WITH y AS {_YEARS}, z AS (SELECT o_custkey, season, total / n / 1000 AS v, n FROM y), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY season DESC) AS r FROM z),
s AS (SELECT c_custkey, c_nationkey, v, n, season, (c_nationkey % 4 + 1) AS st, (c_custkey % 4 + 1) AS dt FROM customer JOIN p ON o_custkey = c_custkey AND r = 1),
k AS (SELECT *, least(greatest((n - 2) * 0.1, -0.75), 0.75) AS d1, least(greatest((c_custkey % 100 - 50) / 50.0 * 0.35 * 0.12, -0.5), 0.5) AS d2, (CASE WHEN g <= 25 THEN -0.5 + g / 25 * 0.25 WHEN g <= 50 THEN -0.25 + (g - 25) / 25 * 0.25 WHEN g <= 75 THEN (g - 50) / 25 * 0.2 ELSE 0.2 + (g - 75) / 25 * 0.3 END) AS d3, least(greatest(CASE WHEN dt < st THEN -0.25 * (st - dt) ELSE 0.15 * (dt - st) END, -0.75), 0.75) AS d4 FROM (SELECT *, (c_custkey % 101)::DOUBLE AS g FROM s)),
t AS (SELECT *, d1 + d2 + d3 + d4 AS dd FROM k), f AS (SELECT *, v + dd * CASE WHEN abs(dd) > 1.5 THEN 1.5 / abs(dd) ELSE 1 END AS value FROM t)"""


@R("C09_destination_projection", _DEST + " SELECT c_custkey, st::INT AS source_tier, dt::INT AS target_tier, round(value, 6) AS value, round(value - 1.2816 * greatest(sqrt(4 + 0.25 * (6.0 / 20) ** 2 + 1) * (1 + 0.15 * least(abs(st - dt), 3)) * (1 + 0.25 * 0.25) * CASE WHEN n < 2 THEN 1.15 ELSE 1 END, 0.1), 6) AS low FROM f")
def c09(spark, d):
    """The latest season's value moved by four capped deltas (role, style, roster, competition) with a widened interval."""
    y = seasons(spark, d).select(F.col("o_custkey").alias("c_custkey"), "season", (F.col("total") / F.col("n") / 1000).alias("v"), "n")
    last = W.latest_per_key(y, "c_custkey", F.desc("season"))
    k = F.col("c_custkey")
    s = J.inner_gate(table(spark, d, "customer"), last, ["c_custkey"]).withColumns({"st": F.col("c_nationkey") % 4 + 1, "dt": k % 4 + 1, "g": (k % 101).cast("double")})
    style = P.style_interactions({"shooting": (k % 100).cast("double")}, {}, F.lit(0.25))
    roster = S.piecewise_linear(F.col("g"), [(0.0, -0.50), (25.0, -0.25), (50.0, 0.0), (75.0, 0.20), (100.0, 0.50)])
    tier = F.when(F.col("dt") < F.col("st"), -0.25 * (F.col("st") - F.col("dt"))).otherwise(0.15 * (F.col("dt") - F.col("st")))
    parts = S.clip_deltas([(F.col("n") - 2) * 0.1, style, roster, tier], [0.75, 0.50, 0.50, 0.75], 1.50)
    s = s.withColumn("value", F.col("v") + parts[0] + parts[1] + parts[2] + parts[3])
    v = F.col("value")
    ci = P.propagate_uncertainty(v, v - 2, v + 2, F.lit(20.0), F.lit(6.0), 1.0, F.lit(False), F.lit(None).cast("double"), F.col("st") - F.col("dt"), F.when(F.col("n") < 2, 1).otherwise(30))
    return s.select("c_custkey", F.col("st").cast("int").alias("source_tier"), F.col("dt").cast("int").alias("target_tier"), r6("value"), r6(ci["low"], "low"))


@R("C10_destination_backtest", f"WITH y AS {_YEARS}, a AS (SELECT o_custkey, season, n, total / n / 1000 AS v FROM y), b AS (SELECT a.o_custkey, a.season, CASE WHEN a.n <= 1 THEN 'low' WHEN a.n <= 3 THEN 'mid' ELSE 'high' END AS cohort, a.v AS p, x.v AS y FROM a JOIN a x ON x.o_custkey = a.o_custkey AND x.season = a.season + 1) SELECT cohort, count(*) AS n, round(avg(p - y), 6) AS mean, round(quantile_cont(round(p - y, 6), 0.5), 6) AS median, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae FROM b GROUP BY 1 HAVING count(*) >= 10")
def c10(spark, d):
    """Each season's value against the next one's, summed up by cohorts of sample size."""
    y = seasons(spark, d).select("o_custkey", "season", "n", (F.col("total") / F.col("n") / 1000).alias("p"))
    both = J.season_offset_join(y, y.select("o_custkey", "season", F.col("p").alias("y")), ["o_custkey"], "season", 1)
    both = both.withColumn("cohort", F.when(F.col("n") <= 1, "low").when(F.col("n") <= 3, "mid").otherwise("high"))
    return E.residual_summary(both, "y", "p", "cohort", 10).select("cohort", "n", r6("mean"), r6("median"), r6("rmse"), r6("mae"))


_RATES = f"""w AS (SELECT *, pow(0.9, 2006 - season) AS w FROM {_LABELLED} WHERE season < 2006), g AS (SELECT sum(w * quality) / sum(w) AS r FROM w),
s AS (SELECT source, sum(w) AS n, sum(w * quality) / sum(w) AS r FROM w GROUP BY 1), c AS (SELECT source, lang, sum(w) AS n, count(*) AS rows, sum(w * quality) / sum(w) AS r FROM w GROUP BY 1, 2)"""


@R("C11_transfer_success", f"""WITH {_RATES}, t AS (SELECT DISTINCT d.source, d.lang FROM documents d), h AS (SELECT source, (n * s.r + 15 * g.r) / (n + 15) AS r FROM s, g)
SELECT t.source, t.lang, round(coalesce((c.n * c.r + 15 * h.r) / (c.n + 15), h.r, g.r), 6) AS rate, (1 + (x >= 0.35)::INT + (x >= 0.5)::INT + (x >= 0.65)::INT + (x >= 0.8)::INT) AS tier, CASE WHEN c.rows IS NOT NULL THEN 'cell' WHEN h.r IS NOT NULL THEN 'pair' ELSE 'overall' END AS level
FROM (SELECT t.*, coalesce((c.n * c.r + 15 * h.r) / (c.n + 15), h.r, g.r) AS x FROM t LEFT JOIN c USING (source, lang) LEFT JOIN h ON h.source = t.source, g) t LEFT JOIN c USING (source, lang) LEFT JOIN h ON h.source = t.source, g""")
def c11(spark, d):
    """Decayed rates of cell, pair and overall, shrunk in turn; the tier and the level that the rate rests on, for every pair that occurs."""
    rates = A.decayed_rates(labelled(spark, d), "quality", "season", 2006, [["source", "lang"], ["source"], []])
    level = lambda k: rates.where(F.col("level") == k)
    cell = level(0).select("source", "lang", F.col("n_eff").alias("cn"), F.col("rate").alias("cr"))
    source = level(1).select("source", F.col("n_eff").alias("sn"), F.col("rate").alias("sr"))
    whole = level(3).select(F.col("n_eff").alias("gn"), F.col("rate").alias("gr"))  # one row
    t = table(spark, d, "documents").select("source", "lang").distinct()
    out = t.join(cell, ["source", "lang"], "left").join(source, "source", "left").crossJoin(F.broadcast(whole))
    rate = A.shrink_chain([(F.col("gr"), F.col("gn")), (F.col("sr"), F.col("sn")), (F.col("cr"), F.col("cn"))], 15.0)
    where = F.when(F.col("cr").isNotNull(), "cell").when(F.col("sr").isNotNull(), "pair").otherwise("overall")
    return out.select("source", "lang", r6(rate, "rate"), S.tier_cut(rate, [0.35, 0.5, 0.65, 0.8]).alias("tier"), where.alias("level"))


@R("P57b_explain_text", f"""WITH {_RATES} SELECT source, lang, (CASE WHEN r >= 0.65 THEN 'A likely success' WHEN r >= 0.5 THEN 'More likely than not' WHEN r >= 0.35 THEN 'A risk' ELSE 'Unlikely' END) || ' (' || round(r * 100)::INT || '%). ' || CASE WHEN rows >= 20 THEN 'Based on ' || rows || ' comparable transfers in this exact situation.' WHEN rows >= 5 THEN 'Based on ' || rows || ' transfers between these styles.' ELSE 'Based on the overall rate, as there is no precedent.' END AS text FROM c""")
def p57b(spark, d):
    """Verdict and grounds of every cell's rate."""
    rows = labelled(spark, d).where("season < 2006").withColumn("w", F.pow(F.lit(0.9), 2006 - F.col("season")))
    c = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("quality")) / F.sum("w")).alias("r"))
    level = F.when(F.col("n") >= 20, "cell").when(F.col("n") >= 5, "pair").otherwise("overall")
    return c.select("source", "lang", X.verdict_text(level, F.col("n"), F.col("r"), F.array().cast("array<string>")).alias("text"))


_REC = """WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
x AS (SELECT c_nationkey, c_custkey, least(greatest(c_acctbal / 100, 0), 100) AS a, (least(greatest(coalesce(o_totalprice, 0) / 100000 - 2, -5), 5) + 5) * 10 AS b FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1 WHERE c_acctbal >= 500),
s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(0.8 * a + 0.2 * b, 6) DESC, c_custkey) AS p1 FROM x), t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(0.3 * a + 0.7 * b, 6) DESC, c_custkey) AS p2 FROM s WHERE p1 <= 50)"""


@R("C13b_recommend", _REC + " SELECT c_nationkey, c_custkey, p1::INT AS place1, p2::INT AS place2, 'Ranked ' || p2 || ' of the shortlist; impact ' || round(b)::INT || ' of 100.' AS text FROM t WHERE p2 <= 10")
def c13b(spark, d):
    """Latest row, floors, a shortlist by default weights, the best of it by the user's, with a sentence."""
    last = W.latest_per_key(table(spark, d, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    rows = E.threshold_filters(table(spark, d, "customer"), {}, {"c_acctbal": 500}).join(last, "c_custkey", "left")
    rows = rows.withColumns({"a": S.clip(F.col("c_acctbal") / 100, 0.0, 100.0), "b": S.impact_fit(F.coalesce("o_totalprice", F.lit(0.0)) / 100000 - 2)})
    score = lambda wa, wb: F.round(wa * F.col("a") + wb * F.col("b"), 6)
    got = topk.two_stage_topk(rows, "c_nationkey", "c_custkey", score(0.8, 0.2), score(0.3, 0.7))
    return got.select("c_nationkey", "c_custkey", "place1", "place2", F.format_string("Ranked %d of the shortlist; impact %d of 100.", "place2", F.round("b").cast("int")).alias("text"))


@R("C14_fit_card", """WITH f AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 100 END AS cal, c_custkey % 100 AS raw, (c_custkey % 37) * 2.0 AS gap FROM customer), s AS (SELECT *, round(0.2 * gap + 0.8 * coalesce(cal, raw), 6) AS score FROM f)
SELECT c_custkey, c_nationkey, score, c_custkey = arg_max(c_custkey, (score, -c_custkey)) OVER (PARTITION BY c_nationkey) AS best FROM s""")
def c14(spark, d):
    """Calibrated scores where there are, else raw ones, a personal weighting, and the best candidate of each school."""
    k = F.col("c_custkey")
    w = N.normalize_weights({"fit": 3.0, "gap": 1.0}, ["fit", "gap"], fixed="gap")
    f = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.coalesce(F.when(k % 3 > 0, F.col("c_acctbal") / 100), k % 100).alias("fit"), ((k % 37) * 2.0).alias("gap"))
    s = f.withColumn("score", F.round(F.col("gap") * w["gap"] + F.col("fit") * w["fit"], 6))
    best = topk.best_of(s, "c_nationkey", "c_custkey", ["score"])
    return s.join(best, "c_nationkey").select("c_custkey", "c_nationkey", "score", (k == F.col("best_score")).alias("best"))


@R("C15_player_card", """WITH o AS (SELECT o_custkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey DESC) AS q FROM orders), e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT c_custkey, c_name, n_name, l.o_totalprice AS last_total, p.o_orderpriority AS mode, e.event_type AS status FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o l ON l.o_custkey = c_custkey AND l.r = 1 LEFT JOIN o p ON p.o_custkey = c_custkey AND p.q = 1 LEFT JOIN e ON e.user_id = c_custkey AND e.r = 1""")
def c15(spark, d):
    """A customer with nation, latest order, the order of the best-placed priority and the latest event."""
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    last = W.latest_per_key(o, "c_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", F.col("o_totalprice").alias("last_total"))
    mode = W.priority_resolve(o, "c_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", F.col("o_orderpriority").alias("mode"))
    e = table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    status = W.latest_per_key(e, "c_custkey", F.desc("ts"), F.desc("event_id")).select("c_custkey", F.col("event_type").alias("status"))
    return J.enrich(c, (last, ["c_custkey"]), (mode, ["c_custkey"]), (status, ["c_custkey"])).select("c_custkey", "c_name", "n_name", "last_total", "mode", "status")


@R("C16_shortlist_board", "SELECT o_orderkey, o_custkey, c_name, round(c_acctbal / 100, 6) AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def c16(spark, d):
    """Saved entities of every owner with names and stored scores, newest first."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", r6(F.col("c_acctbal") / 100, "score"))
    saved = table(spark, d, "orders").where("o_orderstatus = 'P'").join(c, "o_custkey")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return saved.select("o_orderkey", "o_custkey", "c_name", "score", F.row_number().over(w).cast("long").alias("place"))


@R("M11b_season_covariates", f"WITH y AS {_YEARS}, z AS (SELECT o_custkey, season, n, (o_custkey + season) % 3 AS owner FROM y) SELECT o_custkey, season, row_number() OVER w AS career_index, coalesce(owner <> lag(owner) OVER w, false)::INT AS moved, coalesce(n - lag(n) OVER w, 0) AS tier_change FROM z WINDOW w AS (PARTITION BY o_custkey ORDER BY season)")
def m11b(spark, d):
    """Career index, moved and tier change of every season."""
    y = seasons(spark, d).select("o_custkey", "season", "n", ((F.col("o_custkey") + F.col("season")) % 3).alias("owner"))
    return B.season_covariates(y, "o_custkey", "season", "owner", "n").select("o_custkey", "season", "career_index", "moved", "tier_change")
