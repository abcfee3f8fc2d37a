"""Operators registered again on tables and values that grow, where the first registration shows too little of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.functions import scalars as S
from lineup.operators import extras as E
from lineup.operators import joins as J
from lineup.operators import sets as U
from lineup.operators import topk
from lineup.plans.base import Registry, r6, table

R = Registry()


@R("P02b_canonical_name", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'ALPHA' WHEN 'Brand#13' THEN 'BETA' ELSE p_brand END AS name FROM part")
def p02b(spark, d):
    return table(spark, d, "part").select("p_partkey", S.canonical_name(F.col("p_brand"), {"Brand#1": "ALPHA", "Brand#13": "BETA"}).alias("name"))


@R("P06b_parse_record", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 41)::INT END AS wins, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 THEN (o_custkey % 31)::INT END AS losses FROM orders")
def p06b(spark, d):
    """Records of orders; some are no record, some have no losses."""
    k = F.col("o_orderkey")
    losses = F.when(k % 11 > 0, (F.col("o_custkey") % 31).cast("string"))
    wins, losses = S.parse_record(F.when(k % 7 > 0, F.concat_ws("-", (k % 41).cast("string"), losses)).otherwise("n/a"))
    return table(spark, d, "orders").select("o_orderkey", wins.alias("wins"), losses.alias("losses"))


@R("P55b_combine_memberships", """WITH x AS (SELECT p_partkey, unnest([0, 1, 2]) AS cluster, unnest([abs(p_size - 5), abs(p_size - 22), abs(p_size - 41)])::DOUBLE AS dist FROM part),
y AS (SELECT p_partkey, unnest([0, 1]) AS cluster, unnest([abs(p_partkey % 50 - 8), abs(p_partkey % 50 - 30)])::DOUBLE AS dist FROM part),
v AS (SELECT *, exp(-(dist - min(dist) OVER k) / greatest(avg(dist) OVER k, 1e-9)) AS raw FROM x WINDOW k AS (PARTITION BY p_partkey)),
w AS (SELECT *, exp(-(dist - min(dist) OVER k) / greatest(avg(dist) OVER k, 1e-9)) AS raw FROM y WINDOW k AS (PARTITION BY p_partkey)),
a AS (SELECT p_partkey, cluster, raw / sum(raw) OVER (PARTITION BY p_partkey) AS weight FROM v), b AS (SELECT p_partkey, cluster, raw / sum(raw) OVER (PARTITION BY p_partkey) AS weight FROM w),
c AS (SELECT a.p_partkey, a.cluster AS a, b.cluster AS b, a.weight * b.weight AS weight FROM a JOIN b ON a.p_partkey = b.p_partkey)
SELECT p_partkey, a, b, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY weight DESC, a, b) AS r FROM c) WHERE r <= 4""")
def p55b(spark, d):
    """Each part's own soft memberships in two clusterings, its four likeliest pairs of six."""
    dist = lambda x, centres: S.soft_memberships(F.array(*[F.abs(x - c).cast("double") for c in centres]))
    both = E.combine_memberships(dist(F.col("p_size"), (5, 22, 41)), dist(F.col("p_partkey") % 50, (8, 30)), 4)
    return table(spark, d, "part").select("p_partkey", F.explode(both).alias("m")).select("p_partkey", "m.a", "m.b", r6("m.weight", "weight"))


@R("T09b_scenario_compare", """WITH s AS (SELECT c_custkey, floor(c_acctbal / 1000)::BIGINT AS v, 1 + c_custkey % 3 AS h FROM customer)
SELECT a.c_custkey AS a, b.c_custkey AS b, a.v - b.v AS margin, abs(a.v - b.v) <= a.h + b.h AS overlap, CASE WHEN a.v > b.v THEN 'a' WHEN b.v > a.v THEN 'b' ELSE 'tie' END AS preferred FROM s a JOIN s b ON b.c_custkey = a.c_custkey + 1""")
def t09b(spark, d):
    v, h = F.floor(F.col("c_acctbal") / 1000), F.col("c_custkey") % 3 + 1
    s = table(spark, d, "customer").select("c_custkey", v.alias("value"), (v - h).alias("low"), (v + h).alias("high"))
    pairs = s.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return E.scenario_compare(s, pairs, "c_custkey").select("a", "b", "margin", "overlap", "preferred")


@R("J14b_fuzzy_initials", """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || p_brand || ' ' || split_part(p_name, ' ', 2) AS full_name FROM part),
m AS (SELECT min(p_partkey) AS best, full_name AS member, left(full_name, 1) || left(split_part(full_name, ' ', 3), 1) AS block FROM p GROUP BY full_name),
n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN full_name WHEN 1 THEN left(full_name, length(full_name) - 1) WHEN 2 THEN replace(full_name, 'Brand', 'xxxxd') WHEN 3 THEN replace(full_name, 'Brand#', 'qqqqqqqqqqqq') WHEN 4 THEN 'zz ' || full_name ELSE regexp_replace(full_name, '[0-9] ', 'x ') END AS name FROM p),
s AS (SELECT p_partkey, best, 1 - levenshtein(name, member) / greatest(length(name), length(member), 1)::DOUBLE AS score FROM n LEFT JOIN m ON block = left(name, 1) || left(split_part(name, ' ', -1), 1)),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC NULLS LAST, best)),
t AS (SELECT *, CASE WHEN score IS NULL OR score < 0.75 THEN 'unmatched' WHEN score < 1 AND score - coalesce(second, 0) < 0.05 THEN 'ambiguous' WHEN score >= 0.82 THEN 'matched' ELSE 'relaxed' END AS status FROM r WHERE rn = 1)
SELECT p_partkey, CASE WHEN status IN ('matched', 'relaxed') THEN best END AS best, round(score, 6) AS score, status FROM t""")
def j14b(spark, d):
    """Every part's name in an altered spelling against the distinct names of its initials; one spelling in six has other initials."""
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", word(1), F.col("p_brand"), word(2)).alias("full_name"))
    full, kind = F.col("full_name"), F.col("p_partkey") % 6
    name = (
        F.when(kind == 0, full)
        .when(kind == 1, F.left(full, F.length(full) - 1))
        .when(kind == 2, F.replace(full, F.lit("Brand"), F.lit("xxxxd")))
        .when(kind == 3, F.replace(full, F.lit("Brand#"), F.lit("qqqqqqqqqqqq")))
        .when(kind == 4, F.concat(F.lit("zz "), full))
        .otherwise(F.regexp_replace(full, "[0-9] ", "x "))
    )
    members = p.groupBy("full_name").agg(F.min("p_partkey").alias("best"))
    out = J.fuzzy_match(p.select("p_partkey", name.alias("name")), members, "p_partkey", "name", "best", "full_name", J.name_block(F.col("name")), J.name_block(full), below=True)
    return out.select("p_partkey", "best", r6("score"), "status")


@R("J26b_key_crosswalk", """WITH f AS (SELECT c_custkey, 1 AS place, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_name ELSE upper(c_name) END AS field FROM customer UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 5 = 0 THEN 'y' || c_name ELSE ' ' || c_name END FROM customer),
k AS (SELECT lower(c_name) AS key, c_name AS canonical FROM customer WHERE c_custkey % 4 > 0)
SELECT c_custkey, coalesce(arg_min(canonical, place) FILTER (canonical IS NOT NULL), arg_min(field, place)) AS canonical FROM f LEFT JOIN k ON key = lower(trim(field)) GROUP BY 1""")
def j26b(spark, d):
    """Two name fields a customer, some misspelt and some of customers that are not known."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    first = F.when(k % 3 == 0, F.concat(F.lit("x"), "c_name")).otherwise(F.upper("c_name"))
    second = F.concat(F.when(k % 5 == 0, "y").otherwise(" "), "c_name")
    fields = c.select("c_custkey", F.posexplode(F.array(first, second)).alias("place", "field"))
    return J.key_crosswalk(fields, c.where(k % 4 > 0).select(F.col("c_name").alias("canonical")), "c_custkey", "place", "field", "canonical")


_WIDTH = 64  # components of an embedding


@R("T03b_top_features", f"SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(list_filter(list_transform(range(1, {_WIDTH + 1}), lambda i: {{'m': -embedding[i]::DOUBLE, 'n': 'f' || i}}), lambda s: s.m < 0)), 1, 2), lambda s: s.n), ',') AS top FROM embeddings")
def t03b(spark, d):
    """The two largest positive of all components."""
    names = [f"f{k + 1}" for k in range(_WIDTH)]
    return table(spark, d, "embeddings").select("vec_id", F.array_join(topk.top_features(F.col("embedding").cast("array<double>"), names, 2), ",").alias("top"))


_MEAN = ", ".join(f"avg(embedding[{k + 1}]::DOUBLE)" for k in range(_WIDTH))


@R("J06b_all_pairs_fit", f"""WITH t AS (SELECT label, (vec_id % 25)::INT AS school, [{_MEAN}] AS v FROM embeddings GROUP BY 1, 2)
SELECT e.vec_id, t.school, round(least(greatest(100 * list_cosine_similarity(e.embedding::DOUBLE[], t.v), 0), 100), 6) AS fit FROM embeddings e JOIN t ON e.label = t.label""")
def j06b(spark, d):
    """Labels are seasons and vec_id % 25 is the school: every vector with the mean vectors of all the schools of its season."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    school = (F.col("vec_id") % 25).cast("int").alias("school")
    targets = e.groupBy("label", school).agg(F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(_WIDTH)]).alias("w"))
    return J.all_pairs_fit(e, targets, "label", "v", "w").select("vec_id", "school", r6("fit"))


@R("J18b_knn", """WITH p AS (SELECT t.vec_id AS target, e.vec_id, list_distance(t.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings e JOIN embeddings t ON t.vec_id % 50 = 0 AND e.vec_id <> t.vec_id)
SELECT target, vec_id, round(distance, 6) AS distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, vec_id) AS place FROM p) WHERE place <= 3""")
def j18b(spark, d):
    """The stated query set of searches against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return J.knn(e, e.where("vec_id % 50 = 0"), "vec_id", "v", 3).select("target", "vec_id", r6("distance"), "place")


_HALVES = "t AS (SELECT user_id, event_type, max(event_id) AS event_id, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), u AS (SELECT user_id, event_type, max(event_id) AS event_id, max(CASE WHEN event_id % 3 > 0 THEN value END) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"


def _halves(spark, d):
    """Every event is on one side: targets are even events, updates odd ones."""
    e = table(spark, d, "events")
    t = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"))
    u = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("event_id") % 3 > 0, F.col("value"))).alias("value"))
    return t, u


@R("S10b_upsert", f"WITH {_HALVES} SELECT * FROM u UNION ALL SELECT * FROM t WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM u)")
def s10b(spark, d):
    t, u = _halves(spark, d)
    return U.upsert(t, u, ["user_id", "event_type"], F.desc("event_id"))


@R("S11b_upsert_coalesce", f"WITH {_HALVES} SELECT coalesce(t.user_id, u.user_id) AS user_id, coalesce(t.event_type, u.event_type) AS event_type, coalesce(t.event_id, u.event_id) AS event_id, coalesce(u.value, t.value) AS value FROM t FULL JOIN u ON t.user_id = u.user_id AND t.event_type = u.event_type")
def s11b(spark, d):
    t, u = _halves(spark, d)
    return U.upsert_coalesce(t, u, ["user_id", "event_type"], ["event_id"])


@R("S12b_upsert_partial", f"WITH {_HALVES} SELECT coalesce(t.user_id, u.user_id) AS user_id, coalesce(t.event_type, u.event_type) AS event_type, coalesce(t.event_id, 0) AS event_id, coalesce(u.value, t.value) AS value FROM t FULL JOIN u ON t.user_id = u.user_id AND t.event_type = u.event_type")
def s12b(spark, d):
    t, u = _halves(spark, d)
    return E.upsert_partial(t, u, ["user_id", "event_type"], ["value"], {"event_id": 0})
