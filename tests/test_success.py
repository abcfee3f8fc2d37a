"""Success of moves against plain loops: rates of earlier seasons, coefficients by season, calibration."""

import math

import pytest
from pyspark.sql import functions as F

from lineup.functions.scalars import logit
from lineup.operators import models as M
from lineup.operators import success as U


def _rows():
    keys = ["a", "b", None]
    return [(i, keys[i % 3], i % 2, 2000 + (i * 7) % 6, None if i % 11 == 0 else (i * i) % 3 % 2, ((i * 37) % 19 - 9) / 5) for i in range(240)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, j int, season int, y int, x double")


def test_expanding_rates_against_loops(spark):
    rows, levels = _rows(), [[], ["k"], ["k", "j"]]
    got = {r["id"]: r for r in U.expanding_rates(_frame(spark, rows), "y", "season", levels, 0.9).withColumns({"rate": U.shrunk_rate(3), "level": U.deciding_level(["all", "k", "cell"])}).collect()}
    assert len(got) == len(rows)
    for i, k, j, season, _, _ in rows:
        rate, n0 = None, 0.0
        for level, same in enumerate((lambda r: True, lambda r: r[1] == k, lambda r: r[1] == k and r[2] == j)):
            past = [(0.9 ** (season - r[3]), r[4]) for r in rows if same(r) and r[3] < season and r[4] is not None]
            n = sum(w for w, _ in past)
            own = sum(w * y for w, y in past) / n if past else None
            assert got[i][f"n_{level}"] == pytest.approx(n) and (got[i][f"r_{level}"] is None) == (own is None)
            n0 = n if level == 0 else n0
            rate = own if level == 0 else (n * (rate if own is None else own) + 15 * rate) / (n + 15) if rate is not None else None
        assert got[i]["rate"] == pytest.approx(rate if n0 > 0 else 0.5)
        assert got[i]["level"] == "bootstrap" if n0 == 0 else got[i]["level"] in ("all", "k", "cell")


def test_empty_and_unlabelled(spark):
    rows = _frame(spark, _rows())
    assert U.expanding_rates(rows.limit(0), "y", "season", [[], ["k"]]).collect() == []
    none = U.expanding_rates(rows.withColumn("y", F.lit(None).cast("int")), "y", "season", [[], ["k"]]).withColumn("rate", U.shrunk_rate(2))
    assert {r["rate"] for r in none.collect()} == {0.5}
    assert U.expanding_beta(rows.withColumn("y", F.lit(None).cast("int")).withColumn("o", F.lit(0.0)), "y", "o", "x", "season") == {}


def test_coefficients_by_season_are_those_of_each_season_alone(spark):
    rows = [(i, "a", 0, 2000 + i % 5, int(((i * 37) % 19 - 9) / 5 + ((i * 53) % 23 - 11) / 4 < 0), ((i * 37) % 19 - 9) / 5) for i in range(300)]
    df = _frame(spark, rows).withColumn("o", logit(F.lit(0.45)))
    got = U.expanding_beta(df, "y", "o", "x", "season", rounds=6)
    assert sorted(got) == [2001, 2002, 2003, 2004, 2005]
    for s, b in got.items():
        assert b == pytest.approx(M.fit_offset_beta(df.where(F.col("season") < s), "y", "o", "x", rounds=6), abs=1e-3)
    assert got[2005] < 0


def test_flat_covariate_has_no_coefficient_and_keeps_rates(spark):
    df = _frame(spark, _rows()).withColumns({"o": F.lit(0.2), "x": F.lit(1.0)})
    betas = U.expanding_beta(df, "y", "o", "x", "season")
    assert betas == {}
    r = df.limit(1).select(U.adjusted(F.lit(0.6), F.col("x"), F.col("season"), betas).alias("p")).first()
    assert r["p"] == pytest.approx(0.6)
    r = df.limit(1).select(U.adjusted(F.lit(0.6), F.lit(2.0), F.lit(2003), {2003: -0.5}).alias("p"), U.adjusted(F.lit(0.6), F.lit(None), F.lit(2003), {2003: -0.5}).alias("q")).first()
    assert r["p"] == pytest.approx(1 / (1 + math.exp(-(math.log(1.5) - 1.0)))) and r["q"] == pytest.approx(0.6)


def test_probabilities_and_calibration(spark):
    from lineup.plans import registry

    rows = registry.QUERIES["C11c_success_probability"](spark, "/root/testdata/sf0.001").collect()
    tiers = registry.QUERIES["C11d_success_calibration"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 < r["probability"] < 1 for r in rows)
    first = min(r["season"] for r in rows)
    assert {r["rate"] for r in rows if r["season"] == first} == {0.5}
    assert sorted(t["tier"] for t in tiers) == [1, 2, 3, 4, 5] and sum(t["n"] for t in tiers) == sum(r["season"] > first for r in rows)
    assert len({t["ece"] for t in tiers}) == 1 and 0 <= tiers[0]["ece"] <= 1
