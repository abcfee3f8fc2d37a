"""Identity resolution queries: parts are players, their sizes and brands are schools, their types are positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import identity as I
from lineup.plans.base import Registry, table

R = Registry()
#: The name of a part: its words with the ending of its brand and the price's cents, so that some names of a block are alike.
_NAME = "split_part(p_name, ' ', 1) || chr(97 + (p_partkey % 7)::INT) || ' ' || split_part(p_name, ' ', 2) || 'son' || chr(97 + (p_size % 5)::INT)"
_POS = "substr(p_type, 1, 2)"
_BLOCK = "(p_size % 10) * 25 + substr(p_brand, 7)::INT"


def _letter(n):
    return F.chr(97 + n)


def _parts(spark, d):
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    full = F.concat(first, _letter(F.col("p_partkey") % 7), F.lit(" "), last, F.lit("son"), _letter(F.col("p_size") % 5))
    block = (F.col("p_size") % 10) * 25 + F.substr("p_brand", F.lit(7)).cast("int")
    return table(spark, d, "part").select("p_partkey", full.alias("full_name"), F.left("p_type", F.lit(2)).alias("position"), block.alias("school"), "p_retailprice")


_ALTERED = "CASE p_partkey % 6 WHEN 0 THEN full_name WHEN 1 THEN left(full_name, length(full_name) - 1) WHEN 2 THEN replace(full_name, 'son', 'sen') WHEN 3 THEN replace(full_name, 'son', 'qqqqqqq') WHEN 4 THEN 'zz' || full_name ELSE replace(full_name, 'e', '') END"


def _altered(c="full_name"):
    full, kind = F.col(c), F.col("p_partkey") % 6
    return (
        F.when(kind == 0, full)
        .when(kind == 1, F.left(full, F.length(full) - 1))
        .when(kind == 2, F.replace(full, F.lit("son"), F.lit("sen")))
        .when(kind == 3, F.replace(full, F.lit("son"), F.lit("qqqqqqq")))
        .when(kind == 4, F.concat(F.lit("zz"), full))
        .otherwise(F.replace(full, F.lit("e"), F.lit("")))
    )


_PARTS = f"p AS (SELECT p_partkey, {_NAME} AS full_name, {_POS} AS position, {_BLOCK} AS school FROM part)"
_LEV = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)::DOUBLE)"


def _match(names: str, roster: str, block: str = "school") -> str:
    on = " AND ".join(f"n.{b} = r.{b}" for b in block.split(","))
    held = " AND ".join(f"h.{b} = n.{b}" for b in block.split(","))
    return f"""SELECT n.name_id, f.member, f.score, CASE WHEN NOT EXISTS (SELECT 1 FROM {roster} r WHERE {on}) THEN 'no_school' WHEN hits IS NULL THEN 'unmatched' WHEN hits = 1 OR same = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM {names} n LEFT JOIN (
  SELECT name_id, count(*) AS hits, count(*) FILTER (own) AS same, CASE WHEN count(*) = 1 THEN min(member) WHEN count(*) FILTER (own) = 1 THEN min(member) FILTER (own) END AS member, CASE WHEN count(*) = 1 THEN min(score) WHEN count(*) FILTER (own) = 1 THEN min(score) FILTER (own) END AS score FROM (
    SELECT *, min(pass) OVER (PARTITION BY name_id) AS first, row_number() OVER (PARTITION BY name_id ORDER BY pass, score DESC, member) AS rn FROM (
      SELECT *, CASE WHEN inside AND score >= 0.82 THEN 1 WHEN inside THEN 2 ELSE 3 END AS pass FROM (
        SELECT n.name_id, r.member, {_LEV.format('n.name', 'r.member_name')} AS score, coalesce(r.member_position = n.position, false) AS own,
          coalesce(r.member_position = n.position, false) OR NOT EXISTS (SELECT 1 FROM {roster} h WHERE {held} AND h.member_position = n.position) AS inside
        FROM {names} n JOIN {roster} r ON {on}) WHERE score >= 0.75))
    WHERE rn <= 3 AND pass = first GROUP BY 1) f ON f.name_id = n.name_id"""


_NAMES = f"n AS (SELECT p_partkey AS name_id, {_ALTERED} AS name, CASE WHEN p_partkey % 5 > 0 THEN position END AS position, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE school END AS school FROM p), ros AS (SELECT p_partkey AS member, full_name AS member_name, position AS member_position, school FROM p)"


def _names(p):
    return p.select(F.col("p_partkey").alias("name_id"), _altered().alias("name"), F.when(F.col("p_partkey") % 5 > 0, F.col("position")).alias("position"), F.when(F.col("p_partkey") % 11 == 0, -1).otherwise(F.col("school")).alias("school"))


def _roster(p):
    return p.select(F.col("p_partkey").alias("member"), F.col("full_name").alias("member_name"), F.col("position").alias("member_position"), "school")


@R("J12b_fuzzy_match", f"WITH {_PARTS}, {_NAMES}, m AS ({_match('n', 'ros')}) SELECT name_id, member, round(score, 3) AS confidence, status FROM m")
def j12b(spark, d):
    """Matched, ambiguous and unmatched names, and names of a school that is not known."""
    p = _parts(spark, d)
    return I.match_names(_names(p), _roster(p), ["school"])


@R("J12c_fuzzy_match_sequence")
def j12c(spark, d):
    """The same with the sequence matcher's ratio; a test compares it with Python's."""
    p = _parts(spark, d)
    return I.match_names(_names(p), _roster(p), ["school"], how="sequence")


def _tokenwise(names: str, members: str, on: str, least: float) -> str:
    a, b = "split_part({0}, ' ', 1)", "split_part({0}, ' ', -1)"
    score = f"least({_LEV.format(a.format('n.name'), a.format('r.member_name'))}, {_LEV.format(b.format('n.name'), b.format('r.member_name'))})"
    return f"""SELECT name_id, member, score FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM (SELECT n.name_id, r.member, {score} AS score FROM {names} n JOIN {members} r ON {on}) WINDOW w AS (PARTITION BY name_id ORDER BY score DESC, member))
  WHERE rn = 1 AND score >= {least} AND (nxt IS NULL OR score - nxt >= 0.05)"""


@R("J13_fuzzy_tokenwise", f"WITH {_PARTS}, {_NAMES} SELECT name_id, member, round(score, 6) AS score FROM ({_tokenwise('n', 'ros', 'n.school = r.school', 0.8)})")
def j13(spark, d):
    p = _parts(spark, d)
    return I.match_tokenwise(_names(p), _roster(p), ["school"], 0.8).select("name_id", "member", F.round("score", 6).alias("score"))


@R("J15_identity_resolution", f"""WITH {_PARTS}, {_NAMES}, u AS (SELECT member_name, min(member) AS member FROM ros GROUP BY 1 HAVING count(*) = 1),
t1 AS (SELECT name_id, min(member) AS member, 1 AS tier FROM n JOIN ros USING (school) WHERE name = member_name GROUP BY 1),
t2 AS (SELECT name_id, member, 2 AS tier FROM ({_tokenwise('n', 'ros', 'n.school = r.school', 0.88)})),
t3 AS (SELECT name_id, member, 3 AS tier FROM n JOIN u ON name = member_name),
t4 AS (SELECT name_id, member, 4 AS tier FROM ({_tokenwise('n', 'u', "true", 0.9)})),
a AS (SELECT name_id, arg_min(member, tier) AS member, min(tier) AS tier FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4) GROUP BY 1),
c AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY (tier IN (1, 3)) DESC, name_id) AS rn FROM a)
SELECT n.name_id, c.member, c.tier, (c.tier IN (1, 3)) AS exact FROM n LEFT JOIN c ON c.name_id = n.name_id AND rn = 1""")
def j15(spark, d):
    p = _parts(spark, d)
    return I.resolve_identities(_names(p), _roster(p), ["school"], [])


@R("J16_direct_then_fuzzy", f"""WITH {_PARTS}, {_NAMES}, k AS (SELECT p_partkey AS member, CASE WHEN p_partkey % 3 = 0 THEN 'e' || p_partkey END AS external FROM part),
x AS (SELECT n.*, CASE WHEN name_id % 2 = 0 THEN 'e' || name_id END AS external FROM n), dir AS (SELECT x.*, k.member AS direct_member FROM x LEFT JOIN k ON k.external = x.external), fz AS (SELECT * FROM dir WHERE direct_member IS NULL), m AS ({_match('fz', 'ros')}),
g AS (SELECT name_id, direct_member AS member, 1.0::DOUBLE AS confidence, 'matched' AS status, true AS direct FROM dir WHERE direct_member IS NOT NULL UNION ALL SELECT name_id, member, round(score, 3), status, false FROM m),
new AS (SELECT g.member, min(x.external) AS ext FROM g JOIN x USING (name_id) WHERE g.member IS NOT NULL AND x.external IS NOT NULL GROUP BY 1),
free AS (SELECT ext, min(new.member) AS member FROM new JOIN k ON k.member = new.member AND k.external IS NULL WHERE ext NOT IN (SELECT external FROM k WHERE external IS NOT NULL) GROUP BY 1)
SELECT g.name_id, g.member, g.confidence, g.status, g.direct, coalesce(k.external, free.ext) AS external FROM g LEFT JOIN k ON k.member = g.member LEFT JOIN free ON free.member = g.member""")
def j16(spark, d):
    """Every second name has an external id, every third member's is known already; the ids of the matched members are filled in."""
    p = _parts(spark, d)
    known = p.select(F.col("p_partkey").alias("member"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("e"), F.col("p_partkey"))).alias("external"))
    rows = _names(p).withColumn("external", F.when(F.col("name_id") % 2 == 0, F.concat(F.lit("e"), F.col("name_id"))))
    got = I.direct_then_fuzzy(rows, known, _roster(p), ["school"])
    filled = I.backfill_ids(known, got.join(rows.select("name_id", "external"), "name_id"))
    return got.join(filled, "member", "left").select("name_id", "member", "confidence", "status", "direct", "external")


_LINES = f"""ev AS (SELECT l_suppkey AS actor, {_ALTERED} AS name, CASE WHEN l_linenumber % 3 > 0 THEN 'B' || p.school END AS team, position FROM lineitem JOIN p ON p_partkey = l_partkey),
nm AS (SELECT actor, arg_min(name, (-c, name)) AS name FROM (SELECT actor, name, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1), tm AS (SELECT actor, arg_min(team, (-c, team)) AS team FROM (SELECT actor, team, count(*) AS c FROM ev WHERE team IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT actor, arg_min(position, (-c, position)) AS position FROM (SELECT actor, position, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1),
ac AS (SELECT actor AS name_id, name, team, position, CASE WHEN substr(team, 2)::INT % 9 > 0 THEN substr(team, 2)::INT END AS school FROM nm LEFT JOIN tm USING (actor) LEFT JOIN ps USING (actor))"""


@R("J22_crosswalk_table", f"WITH {_PARTS}, ros AS (SELECT p_partkey AS member, full_name AS member_name, position AS member_position, school FROM p), {_LINES}, m AS ({_match('ac', 'ros')}) SELECT name_id AS actor, name, team, position, school, member, round(score, 3) AS confidence, status FROM ac JOIN m USING (name_id)")
def j22(spark, d):
    """Suppliers are source actors, their line items' parts give the names and teams; one team in nine has no school."""
    p = _parts(spark, d)
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    # names and teams are made once a part, not once a line item
    parts = p.select("p_partkey", _altered().alias("name"), F.concat(F.lit("B"), "school").alias("team"), "position")
    events = li.join(parts, "p_partkey").select(F.col("l_suppkey").alias("actor"), "name", F.when(F.col("l_linenumber") % 3 > 0, F.col("team")).alias("team"), "position")
    schools = p.select("school").distinct().where("school % 9 > 0").select(F.concat(F.lit("B"), "school").alias("team"), "school")
    got, _ = I.crosswalk_table(events, schools, _roster(p))
    return got.select("actor", "name", "team", "position", "school", "member", "confidence", "status")


_MOVES = "ev AS (SELECT p_partkey AS name_id, " + _ALTERED + " AS name, position, 3 + p_partkey % 2 AS season, CASE WHEN p_partkey % 13 > 0 THEN school END AS school, CASE WHEN p_partkey % 4 > 0 THEN (school + 1) % 260 END AS to_school FROM p), rs AS (SELECT p_partkey AS member, full_name AS member_name, position AS member_position, school, 3 + (p_partkey % 3) - 1 AS season FROM p)"


@R("J24_resolve_from_to", f"""WITH {_PARTS}, {_MOVES}, m AS ({_match('ev', 'rs', 'school,season')}), ag AS (SELECT ev.* REPLACE (season - 1 AS season) FROM ev JOIN m USING (name_id) WHERE status IN ('unmatched', 'ambiguous')), m2 AS ({_match('ag', 'rs', 'school,season')})
SELECT ev.name_id, ev.school AS from_school, CASE WHEN ev.to_school IN (SELECT school FROM p) THEN ev.to_school END AS to_school, coalesce(m.member, b.member) AS member, round(coalesce(m.score, b.score), 3) AS confidence, CASE WHEN b.member IS NOT NULL THEN 'matched' ELSE m.status END AS status
FROM ev JOIN m USING (name_id) LEFT JOIN (SELECT * FROM m2 WHERE status = 'matched') b USING (name_id)""")
def j24(spark, d):
    """Rosters lie over three seasons, events in two; names that are not found are looked up in the season before."""
    p = _parts(spark, d)
    team = lambda x: F.concat(F.lit("B"), x)
    events = p.select(F.col("p_partkey").alias("name_id"), _altered().alias("name"), "position", (3 + F.col("p_partkey") % 2).alias("season"), team(F.when(F.col("p_partkey") % 13 > 0, F.col("school"))).alias("from_team"), team(F.when(F.col("p_partkey") % 4 > 0, (F.col("school") + 1) % 260)).alias("to_team"))
    schools = p.select("school").distinct().select(team(F.col("school")).alias("team"), "school")
    return I.resolve_from_to(events, schools, _roster(p).withColumn("season", 3 + (F.col("member") % 3) - 1))
