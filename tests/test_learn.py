"""Seeded and composite operators against NumPy twins, purity and error bounds; gates on texts of their own kind."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lineup.functions import text as X
from lineup.operators import learn as L
from lineup.operators import models as M
from lineup.plans import registry

DIR = "/root/testdata/sf0.001"


def lines(columns):
    got = duckdb.sql(f"SELECT {columns} FROM '{DIR}/lineitem.parquet'").fetchnumpy()
    return [np.asarray(v, dtype=float) for v in got.values()]


def test_attribution_equals_numpy(spark):
    keys, names = "l_orderkey, l_partkey, l_suppkey, l_linenumber", ["l_quantity", "l_discount", "l_tax"]
    *ids, y, a, b, c = lines(f"{keys}, l_extendedprice, {', '.join(names)}")
    x = np.stack([a, b, c], axis=1)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / sd
    want = sorted((*(int(k[i]) for k in ids), n, round(float((x[i, j] - mean[j]) * beta[j]), 2)) for i in range(len(y)) for j, n in enumerate(names))
    got = sorted((r["l_orderkey"], r["l_partkey"], r["l_suppkey"], r["l_linenumber"], r["feature"], round(r["value"], 2)) for r in registry.QUERIES["M26_linear_attribution"](spark, DIR).collect())
    assert len(got) == len(want) and all(g[:5] == w[:5] and abs(g[5] - w[5]) < 0.02 for g, w in zip(got, want))


def test_value_drivers_are_the_largest_contributions(spark):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    parts = {}
    for r in registry.QUERIES["M26_linear_attribution"](spark, DIR).collect():
        parts.setdefault(tuple(r[k] for k in keys), []).append((-r["value"], r["feature"]))
    got = registry.QUERIES["T04_value_drivers"](spark, DIR).collect()
    wrong = 0
    for r in got:
        own = sorted(set(parts[tuple(r[k] for k in keys)]))
        if len(own) == 3 and min(abs(own[i][0] - own[i + 1][0]) for i in (0, 1)) > 1e-5 and all(abs(v) > 1e-5 for v, _ in own):
            wrong += r["drivers"] != ",".join([f for v, f in own if v < 0][:2])
    assert len(got) == 6000 and wrong == 0


def blobs(spark, n=900):
    rng = np.random.default_rng(2)
    centre = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 6]], dtype=float)
    x = [(k, k % 3, *(centre[k % 3] + rng.normal(0, 0.7, 3)).tolist()) for k in range(n)]
    return spark.createDataFrame(x, "id long, truth int, a double, b double, c double"), np.array([r[2:] for r in x]), np.array([r[1] for r in x])


def test_clusters_find_the_groups_in_fixed_slots(spark):
    df, x, truth = blobs(spark)
    centres = L.relabel(L.fit_centres(df, ["a", "b", "c"], 3), ["a", "b", "c"], [(2, {"a": 1.0}), (0, {"b": 1.0, "c": 1.0})])
    got = L.assign(df, ["a", "b", "c"], centres, F.col("id") % 2 == 0, 2).collect()
    slot = {1: 2, 2: 0, 0: 1}
    assert np.mean([r["cluster"] == slot[r["truth"]] for r in got]) > 0.99
    assert max(r["confidence"] for r in got if r["id"] % 2) <= 0.75 < max(r["confidence"] for r in got if r["id"] % 2 == 0)
    both = L.two_layer_clusters(df, (["a"], centres[:, :1]), (["b", "c"], centres[:, 1:]), F.col("id") > 10, (["x", "y", "z"], ["p", "q", "r"])).collect()
    assert all(r["system"].endswith("defense not known") == (r["id"] <= 10) for r in both)


def test_cluster_quality_equals_numpy(spark):
    df, x, _ = blobs(spark, 300)
    centres = L.fit_centres(df, ["a", "b", "c"], 3)
    got = L.cluster_quality(df, ["a", "b", "c"], centres)
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    label = d.argmin(axis=1)
    pair = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    s = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        a, b = pair[i][own].mean(), min(pair[i][label == o].mean() for o in set(label) if o != label[i])
        s.append((b - a) / max(a, b))
    assert abs(got["silhouette"] - np.mean(s)) < 1e-6 and abs(got["inertia"] - d.min(axis=1).sum()) < 1e-6
    sweep = {r["k"]: r["inertia"] for r in L.k_sweep(df, "id", ["a", "b", "c"], [2, 3]).collect()}
    assert sweep[3] < 0.5 * sweep[2]


def test_components_equal_numpy(spark):
    df, x, _ = blobs(spark)
    m = L.pca(df, ["a", "b", "c"], 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    value, vector = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(m["explained"], (value[::-1] / value.sum())[:2]) and np.allclose(np.abs(m["components"]), np.abs(vector[:, ::-1][:, :2].T))
    got = df.orderBy("id").select(*L.pca_columns(m)).toPandas().to_numpy()
    assert np.allclose(got, z @ np.array(m["components"]).T)


def test_staged_boosting_beats_the_mean(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, (1200, 3))
    share = np.clip(0.1 + 0.8 * x[:, 0] + rng.normal(0, 0.05, 1200), 0, 1)
    usage = 10 + 25 * x[:, 1] + rng.normal(0, 1, 1200)
    df = spark.createDataFrame([(k, *map(float, (*x[k], share[k], usage[k]))) for k in range(1200)], "id long, a double, b double, c double, share double, usage double")
    run = L.staged_boosting(df.where("id < 800"), ["a", "b", "c"], "share", "usage", rounds=5, depth=3)
    got = run(df.where("id >= 800")).toPandas()
    assert ((got.expected_share - got.share) ** 2).mean() < 0.2 * got.share.var() and ((got.expected_usage - got.usage) ** 2).mean() < 0.2 * got.usage.var()
    assert (got.p_starter <= got.p_rotation + 1e-12).all() and (got.p_heavy <= got.p_starter + 1e-12).all()
    held = run(df.where("id between 600 and 799")).select("share", "expected_share", F.lit(1).alias("g"))
    out = L.conformal_interval(held, run(df.where("id >= 800")).withColumn("g", F.lit(2)), "share", "expected_share", ["g"]).toPandas()
    assert ((out.low <= out.expected_share) & (out.expected_share <= out.high)).all() and 0.5 < ((out.low <= out.share) & (out.share <= out.high)).mean() < 0.98


URLS = {"womens": "/wbb/", "football": "/football/", "wanted": "/basketball/"}
TEXTS = {"womens": r"(?i)\bwomen's\b", "football": r"(?i)\bquarterback\b", "other": r"(?i)\bpitcher\b", "wanted": r"(?i)\bguard\b|\bbasketball\b"}
EVENTS = {"portal": r"enters? the portal|transfer portal", "coach": r"coach.*fired"}


def test_gate_and_events(spark):
    rows = [
        ("https://x/basketball/a", "Guard enters transfer portal", "", True, None, "portal", 0.9),
        ("https://x/wbb/a", "Guard leaves the portal", "", False, "womens_url", "unknown", 0.0),
        ("https://x/n", "The Women's cup", "", False, "womens_text:Women's", "unknown", 0.0),
        ("https://x/n", "Quarterback enters the portal", "basketball too", False, "conflicting_signals", "portal", 0.9),
        ("https://x/football/n", "Signs", "", False, "football_url", "unknown", 0.0),
        ("https://x/n", "Quarterback signs", "", False, "football_text:Quarterback", "unknown", 0.0),
        ("https://x/n", "Pitcher signs", "", False, "other_text:Pitcher", "unknown", 0.0),
        ("https://x/n", "Pitcher and guard", "", True, None, "unknown", 0.0),
        ("https://x/n", "News", "The coach was fired on Monday", True, None, "coach", 0.7),
        (None, None, None, True, None, "unknown", 0.0),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "url string, title string, body string")
    got = df.select(X.topic_gate(F.col("url"), F.col("title"), F.col("body"), URLS, TEXTS).alias("g"), X.classify_event(F.col("title"), F.col("body"), EVENTS).alias("e")).collect()
    for r, w in zip(got, rows):
        assert (r["g"]["kept"], r["g"]["reason"], r["e"]["event"], r["e"]["confidence"]) == w[3:], w


def test_gated_weights_keep_defaults_without_gain(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, *map(float, rng.normal(size=2)), float(rng.normal())) for k in range(600)], "id long, a double, b double, y double")
    g = L.gated_weights(df.where("id < 400"), df.where("id >= 400"), "y", ["a"], ["b"], {"b": 0.12})
    assert not g["accepted"] and g["weights"] == {"b": 0.12}
    g = L.gated_weights(df.where("id < 400").withColumn("y", 3 * F.col("b")), df.where("id >= 400").withColumn("y", 3 * F.col("b")), "y", ["a"], ["b"], {"b": 0.12})
    assert g["accepted"] and abs(g["weights"]["b"] - 3) < 1e-6
    assert M.ridge_fit(df, "y", ["a", "b"])["features"] == ["a", "b"]
