import math
import statistics

from pyspark.sql import functions as F

from lineup.functions import scalars as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normal_quantile_and_score(spark):
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999):
        got = one(spark, S.normal_quantile(F.lit(p)).alias("q"))["q"]
        assert math.isclose(got, statistics.NormalDist().inv_cdf(p), rel_tol=1e-7, abs_tol=1e-8)
    r = one(spark, S.percentile_to_score(F.lit(0.0)).alias("a"), S.percentile_to_score(F.lit(None).cast("double")).alias("b"))
    assert r["a"] == 10 and r["b"] is None


def test_cleaning(spark):
    r = one(
        spark,
        S.height_to_inches(F.lit("6-3")).alias("h"),
        S.normalize_name(F.lit("  José  Núñez Jr. ")).alias("n"),
        S.swap_last_first(F.lit("Boozer, Cameron")).alias("s"),
        S.season_label(F.lit(2000)).alias("l"),
        S.parse_season(F.lit("2025/26")).alias("p"),
        S.safe_cast(F.lit("x"), "int").alias("c"),
        S.initials(F.lit("Ann Mary Lee III")).alias("i"),
    )
    assert (r["h"], r["n"], r["s"], r["l"], r["p"], r["c"], r["i"]) == (75, "jose nunez", "Cameron Boozer", "1999-00", 2026, None, "al")


def test_stable_id_is_63_bit(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"key").digest()[:8], "big") & ((1 << 63) - 1)
    assert one(spark, S.stable_id(F.lit("key")).alias("i"))["i"] == want


def test_parts_add_up(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))
    r = one(spark, S.cosine_score(a, b).alias("c"), F.aggregate(S.cosine_contributions(a, b), F.lit(0.0), lambda s, x: s + x).alias("p"), S.cosine_score(a, F.array(F.lit(0.0), F.lit(0.0))).alias("z"))
    assert math.isclose(r["c"], 80.0) and math.isclose(r["p"], 80.0) and r["z"] == 50.0


def test_clip_deltas_scale_to_total(spark):
    parts = S.clip_deltas([F.lit(2.0), F.lit(2.0)], [0.75, 0.75], 1.0)
    r = one(spark, *[p.alias(f"c{i}") for i, p in enumerate(parts)])
    assert math.isclose(r[0] + r[1], 1.0) and math.isclose(r[0], 0.5)


def test_weights():
    assert S.normalize_weights({"a": 0, "b": 0, "t": 0.2}, ["a", "b", "t"], ("t", 0.2)) == {"a": 0.4, "b": 0.4, "t": 0.2}
