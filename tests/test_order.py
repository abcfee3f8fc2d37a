"""Ranks and percentiles that split, against Spark's own on groups beyond one bracket; fits, states and names against plain twins."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.operators import identity, order, rosters, states
from lineup.operators import windows as W


def rows(spark, n=30_000):
    r = random.Random(4)
    data = [(r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.05 else round(r.gauss(0, 1), r.choice([1, 4]))) for _ in range(n)]
    return spark.createDataFrame(data + [("one", 3.0), ("none", None)], "g string, v double")


@pytest.mark.parametrize("few", [10, 7_000, 100_000])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)  # all groups but those of one row are split, some are, none is
    df, probs = rows(spark), [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    got = {r["g"]: r["quantiles"] for r in order.quantiles(df, "g", F.col("v"), probs).collect()}
    assert set(got) == {g for g in want if want[g] is not None and want[g][0] is not None}
    for g, q in got.items():
        assert np.allclose(q, want[g], atol=1e-12)
    whole = order.quantiles(df, [], F.col("v"), probs).first()["quantiles"]
    assert np.allclose(whole, df.agg(F.percentile("v", probs)).first()[0])
    assert order.quantiles(df.where("v > 99"), [], F.col("v"), [0.5]).count() == 0


@pytest.mark.parametrize("few", [10, 100_000])
def test_ranks_equal_windows(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    df = rows(spark).withColumn("id", F.monotonically_increasing_id())
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())
    want = df.where("v is not null").withColumns({"r": F.rank().over(w), "t": F.count("*").over(Window.partitionBy("g", "v")), "n": F.count("*").over(Window.partitionBy("g"))})
    both = order.ranked(df, "g", "v").join(want.select("id", "r", "t", "n"), "id", "left")
    assert both.count() == df.count()
    assert both.where("not (_before <=> r - 1) or not (_ties <=> t) or not (_n <=> n)").isEmpty()
    got = W.zscore_by(df, "g", "v", "z").groupBy("g").agg(F.avg("z").alias("m"), F.stddev_pop(F.when(F.col("v").isNotNull(), F.col("z"))).alias("s")).collect()
    assert all(abs(r["m"]) < 1e-6 for r in got)


def test_sequence_ratio_is_pythons(spark):
    names = ["matthew mayer", "matthew moyer", "tj johnson", "rj johnson", "", "a"]
    df = spark.createDataFrame([(a, b) for a in names for b in [*names, None]], "a string, b string")
    for r in df.withColumn("s", identity.sequence_ratio(F.col("a"), F.col("b"))).collect():
        assert r["s"] == (None if r["b"] is None else difflib.SequenceMatcher(None, r["a"], r["b"]).ratio())


def test_names_in_passes(spark):
    roster = [(1, "matthew mayer", "SF", 1), (2, "matthew moyer", "PG", 1), (3, "tj johnson", "C", 1), (4, "alan smith", "PG", 2)]
    names = [(1, "matthew mayer", "SF", 1), (2, "matthew mayor", None, 1), (3, "alan smyth", "C", 2), (4, "zzz", None, 2), (5, "alan smith", None, 9)]
    r = spark.createDataFrame(roster, "member long, member_name string, member_position string, school int")
    n = spark.createDataFrame(names, "name_id long, name string, position string, school int")
    for how in ("edits", "sequence"):
        got = {x["name_id"]: (x["member"], x["status"]) for x in identity.match_names(n, r, ["school"], how).collect()}
        assert got == {1: (1, "matched"), 2: (None, "ambiguous"), 3: (4, "matched"), 4: (None, "unmatched"), 5: (None, "no_school")}


def test_noise_fit_finds_the_noise(spark):
    rng = np.random.default_rng(3)
    data = []
    for k in range(300):
        level = np.cumsum(rng.normal(0, 1.5**0.5, 25)) + 5
        data += [(k, t, float(level[t] + rng.normal(0, 2)), 4.0) for t in range(25)]
    df = spark.createDataFrame(data, "k long, t int, y double, r double").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "y", "r"))).alias("o"))
    q = states.fit_process_noise(df.withColumns({"prior_mean": F.lit(5.0), "prior_var": F.lit(4.0)}), "k")
    assert 1.1 < q < 2.0


def test_drift_fit_finds_the_drift(spark):
    rng = np.random.default_rng(5)
    data = []
    for k in range(800):
        a = 3.0
        for t in range(6):
            moved, tier = int(rng.random() < 0.3), int(rng.integers(-1, 2))
            a = 0.6 * a + 1.0 + 0.1 * t + 0.5 * moved - 0.4 * tier + rng.normal(0, 0.5)
            data.append((k, t, a + rng.normal(0, 0.1), 0.01, t, moved, tier))
    df = spark.createDataFrame(data, "k long, s int, y double, r double, x int, moved int, tier int")
    fit = states.fit_drift(df, "k", "s", "y", "r", ("x", "moved", "tier"))
    assert 0.4 < fit["rho"] < 0.95 and abs(fit["betas"][3] - 0.5) < 0.12 and abs(fit["betas"][4] + 0.4) < 0.12 and 0.1 < fit["q"] < 0.6


def test_bootstrap_interval_is_as_wide_as_numpys(spark):
    member = [(1, m, 10.0 + m, p, float(m) / 4, 0.5, 0.3, 0.25, 20.0, True) for m, p in enumerate(("PG", "SG", "SF", "PF", "C"))]
    r = spark.createDataFrame(member, "school int, member long, min_pct double, position string, off double, deff double, three double, oreb double, usage double, known boolean")
    c = spark.createDataFrame([(1, 0.5, 2, 68.0)], "school int, returning_share double, tier int, tempo double")
    p = spark.createDataFrame([(7, 1, 20.0, 18.0, 6.0, "PG", 0.3, 0.25, 20.0)], "pair long, school int, minutes double, displaced double, value double, cand_position string, cand_three double, cand_oreb double, cand_usage double")
    off = {"features": list(rosters.ROSTER_FEATURES), "coef": [2.0] + [0.0] * 13, "intercept": 100.0}
    deff = {"features": list(rosters.ROSTER_FEATURES), "coef": [0.0, -1.0] + [0.0] * 12, "intercept": 100.0}
    one = rosters.counterfactual(p, r, c, off, deff).first()
    got = rosters.bootstrap_interval(p, r, c, off, deff, 2.0, n=400).first()
    share = np.array([10.0, 11, 12, 13, 14]) / 60
    left, give = np.array([10.0, 11, 12, 13, 14]), 9.0
    for k in range(5):  # the smallest shares give way first
        less = min(left[k], give)
        left[k], give = left[k] - less, give - less
    after = np.append(left, 10.0) / (left.sum() + 10)
    values = np.array([0, 0.25, 0.5, 0.75, 1.0])
    assert abs(one["delta_o"] - 2 * (after @ np.append(values, 3.3) - share @ values)) < 1e-9
    rng = np.random.default_rng(1)
    draws = []
    for _ in range(4000):
        noise, own = rng.normal(0, 0.6, 5), rng.normal(0, 0.6)
        o = 2 * (after @ np.append(values + noise, (6 + own) * 0.55) - share @ (values + noise))
        d = -(after @ np.append(0.5 + noise / 2, (6 + own) * 0.45) - share @ (0.5 + noise / 2))
        draws.append(o - d)
    low, high = np.percentile(draws, [10, 90])
    assert abs(got["low"] - low) < 0.15 and abs(got["high"] - high) < 0.15


def test_noise_grid_does_not_depend_on_the_order_of_series(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [(float(y), 4.0) for y in rng.normal(10, 40, 5)]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, o array<struct<y:double,r:double>>").withColumns({"prior_mean": F.lit(5.0), "prior_var": F.lit(4.0)}).cache()
    sums = {n: tuple(r["nll"] for r in states.noise_grid(df.repartition(n, "k").sortWithinPartitions(F.xxhash64("k", F.lit(n))), [0.1, 1.0, 10.0]).orderBy("q").collect()) for n in (1, 2, 3, 5)}
    assert len(set(sums.values())) == 1


def test_percentile_query_reads_staged_rows(spark):
    """The seasons' sums and their join are made once, not by every step of the two ranks."""
    from lineup.plans import registry

    files = registry.QUERIES["W11_national_percentile"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("orders.parquet" in f for f in files)
