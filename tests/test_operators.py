import math

from pyspark.sql import functions as F

from lineup.operators import aggregates as A
from lineup.operators import joins as J
from lineup.operators import models as M
from lineup.operators import sets as U
from lineup.operators import topk, windows as W


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_calibration_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None), ("b", 4, 1.0)], "g string, id int, v double")
    got = {r["id"]: r["s"] for r in W.calibrate_within(df, "g", "v", "s").collect()}
    assert got[1] == got[2] and math.isclose(got[1], 50.0, abs_tol=1e-6) and got[3] is None and math.isclose(got[4], 50.0, abs_tol=1e-6)


def test_tier_rules_differ_on_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)], "id int, v double").withColumn("g", F.lit(0))
    tiers = {rule: dict(rows(W.competition_tier(df, "g", "v", "t", rule), "id", "t")) for rule in ("min", "average", "share")}
    assert tiers["min"][1] == 4 and tiers["average"][1] == 2 and tiers["share"][1] == 1 and all(t[4] == 1 for t in tiers.values())


def test_cascade_takes_smallest_first(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 3.0), (3, 5.0)], "id int, m double").withColumn("k", F.lit(1))
    assert rows(W.cascade_reduce(df, "k", "m", F.lit(9.0), ["m", "id"]), "id", "reduced") == [(1, 1.0), (2, 3.0), (3, 5.0)]


def test_segments_end_with_boundary(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "g int, t int, b boolean")
    assert rows(W.segment_id(df, "g", "t", F.col("b")), "t", "segment_id") == [(1, 0), (2, 0), (3, 1)]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    u = spark.createDataFrame([(2, "c", None), (3, "d", 3), (3, "e", 4)], "k int, s string, n int")
    once = U.upsert(t, u, ["k"], F.desc("n"))
    assert rows(once, "k", "s") == [(1, "a"), (2, "c"), (3, "e")]
    assert rows(U.upsert(once, u, ["k"], F.desc("n")), "k", "s") == rows(once, "k", "s")
    kept = U.upsert_coalesce(t, u.where("k < 3"), ["k"], ["s"])
    assert rows(kept, "k", "s", "n") == [(1, "a", 1), (2, "b", 2)]


def test_lifecycle_keeps_latest_stage_and_first_date(spark):
    df = spark.createDataFrame([(1, "Entered", None), (1, "Committed", "2024-05-01"), (1, "Entered", "2024-04-01")], "k int, s string, d string")
    assert rows(U.merge_lifecycle(df, ["k"], "s", ["Entered", "Committed"], ["d"]), "k", "s", "d") == [(1, "Committed", "2024-04-01")]


def test_fuzzy_statuses(spark):
    names = spark.createDataFrame([(1, "marcus smith"), (2, "marcus smyth"), (3, "zz top"), (4, "none")], "id int, name string").withColumn("b", F.when(F.col("id") == 4, "y").otherwise("x"))
    roster = spark.createDataFrame([(10, "marcus smith"), (11, "john carter")], "pid int, pname string").withColumn("rb", F.lit("x"))
    got = J.fuzzy_match(names, roster, "id", "name", "pid", "pname", F.col("b"), F.col("rb"))
    assert rows(got.select("id", "status", F.coalesce("pid", F.lit(-1)).alias("pid")), "id", "status", "pid") == [(1, "matched", 10), (2, "matched", 10), (3, "unmatched", -1), (4, "unmatched", -1)]


def test_comps_are_strictly_earlier(spark):
    hist = spark.createDataFrame([("c", 2001, 1), ("c", 2002, 2), ("c", 2003, 3)], "cell string, season int, item int")
    got = J.attach_comps(hist.select("cell", "season"), hist, ["cell"], "season", "item", 2)
    assert {r["season"]: r["comps"] for r in got.collect()} == {2001: [], 2002: [1], 2003: [2, 1]}


def test_ridge_matches_least_squares(spark):
    data = [(float(x), float(z), 3.0 * x - 2.0 * z + 1.0) for x in range(6) for z in (0, 1, 5)]
    m = M.ridge_fit(spark.createDataFrame(data, "x double, z double, y double"), "y", ["x", "z"])
    assert all(math.isclose(a, b, abs_tol=1e-8) for a, b in zip(m["coef"] + [m["intercept"]], [3.0, -2.0, 1.0]))


def test_kalman_skips_missing(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("r")), F.struct(F.lit(4.0).alias("y"), F.lit(1.0).alias("r"))).alias("o"))
    s = df.select(M.kalman_filter(F.col("o"), 1.0, F.lit(0.0), 1.0).alias("s")).first()["s"]
    assert math.isclose(s["m"], 4.0 * 3 / 4) and math.isclose(s["v"], 0.75)


def test_future_labels_do_not_change_the_past(spark):
    df = spark.createDataFrame([("a", 2000, 1), ("a", 2001, 0), ("a", 2005, 1)], "c string, s int, y int")
    past = A.decayed_rates(df, "y", "s", 2002, [["c"]]).collect()
    flipped = A.decayed_rates(df.withColumn("y", F.when(F.col("s") == 2005, 0).otherwise(F.col("y"))), "y", "s", 2002, [["c"]]).collect()
    assert past == flipped


def test_two_stage_keeps_ten(spark):
    df = spark.range(200).select(F.lit(1).alias("u"), "id", F.col("id").cast("double").alias("s"))
    got = topk.two_stage_topk(df, "u", "id", F.col("s"), -F.col("s"))
    assert [r["id"] for r in got.orderBy("place2").collect()] == list(range(150, 160))


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "g string, v double, w double")
    assert A.weighted_mean(df, "g", "v", "w").count() == 0 and W.calibrate_within(df, "g", "v", "s").count() == 0
