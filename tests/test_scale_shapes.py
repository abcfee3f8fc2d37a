"""Neighbours by pivot cells, running sums in parts, embedded JSON and wide CSV: against plain versions."""

import json

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineup.operators import neighbours, scan, windows
from lineup.sources import io


def brute(points, targets, n):
    out = {}
    for t, v in targets:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), k) for k, w in points if k != t)
        out[t] = near[:n]
    return out


def check_knn(spark, points, targets, n):
    schema = "id long, v array<double>"
    got = {}
    for r in neighbours.knn(spark.createDataFrame(points, schema), spark.createDataFrame(targets, schema), "id", "v", n).orderBy("place").collect():
        got.setdefault(r["target"], []).append((r["distance"], r["id"]))
    want = {t: v for t, v in brute(points, targets, n).items() if v}
    assert got.keys() == want.keys()
    for t, near in want.items():
        assert [k for _, k in got[t]] == [k for _, k in near]
        assert np.allclose([d for d, _ in got[t]], [d for d, _ in near])


def clusters(n, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 20, (12, 6))
    return [(k, (centre[k % 12] + rng.normal(0, 0.5, 6)).round(3).tolist()) for k in range(n)]


def test_neighbours_are_exact(spark, monkeypatch):
    points = clusters(600) + [(1000 + k, clusters(1)[0][1]) for k in range(5)]  # and copies that tie
    for cell in (20_000, 7):  # the second deals cells to several tasks
        monkeypatch.setattr(neighbours, "CELL", cell)
        check_knn(spark, points, points[::20] + points[-3:], 4)
    check_knn(spark, points[:3], points[:2], 5)  # fewer points than asked for


def test_odd_vectors_take_no_part(spark):
    rows = [*clusters(40), (100, None), (101, [1.0] * 5 + [None]), (102, [1.0, 2.0]), (103, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = neighbours.knn(df, df, "id", "v", 3)
    assert got.where("target >= 100 or id >= 100").isEmpty() and got.count() == 120
    assert neighbours.knn(df.limit(0), df, "id", "v", 3).isEmpty()


def test_most_cells_are_never_read(spark):
    df = spark.createDataFrame(clusters(3000), "id long, v array<double>")
    index = neighbours.Index(df, "id", "v")
    targets = df.where("id % 50 = 0").select(F.col("id").alias("target"), F.col("v").alias("w"))
    first = neighbours._best(index.search(index.visits(targets, 3, False), 3), 3)
    bounds = targets.join(first.where("place = 3").select("target", F.col("distance").alias("bound")), "target")
    read = index.visits(targets, 3, False).count() + index.visits(bounds, 3, True).count()
    assert read < 0.2 * targets.count() * len(index.pivots)


def test_running_sums_in_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(("hot" if k % 3 else f"k{k % 7}"), int(rng.integers(0, 400)), k, int(rng.integers(-5, 6))) for k in range(3000)] + [(None, 1, 1, 2), ("hot", None, 5000, 7)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v int")
    w = Window.partitionBy("g").orderBy(F.asc_nulls_first("t"), "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("want", F.coalesce(F.sum("v").over(w), F.lit(0)))
    for n in (10**6, 50):
        got = scan.sum_before(df, "g", ["id"], F.col("v"), "got", "t", rows=n)
        assert got.count() == len(rows)
        assert got.join(want.select("id", "v", "want"), ["id", "v"]).where("not (got <=> want)").isEmpty()
    sizes = scan.parts_of(df, ["g"], "t", rows=50).groupBy("g", "_part").count().where("g = 'hot'")
    assert sizes.agg(F.max("count")).first()[0] < 200  # 2,001 rows of the hot key


def test_segments_of_a_hot_key(spark, monkeypatch):
    df = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 10 == 9).alias("b"))
    monkeypatch.setattr(scan.sum_before, "__defaults__", (40,))
    got = windows.segment_id(df, "k", "t", F.col("b"))
    assert got.where("segment_id != floor(t / 10)").isEmpty()


def records(spark, html, schema="struct<a:string,b:array<array<int>>>"):
    df = spark.createDataFrame([(k, h) for k, h in enumerate(html)], "page int, html string")
    return [(r["page"], r["record"]["a"], r["record"]["b"]) for r in io.extract_embedded_json(df, "html", "data =", schema).orderBy("page").collect()]


def test_embedded_json_knows_strings_and_escapes(spark):
    strings = ["a ]; b", "} ] undefined {", 'he said "]"', "back \\", "\\\\\" ]", "line\nend", "tab\t", "<b>;</b>", "ünï ]"]
    pages = [f"<script>x = [0]; data = {json.dumps([{'a': s, 'b': [[1, 2], [3]]}], ensure_ascii=False)};\nmore = [9];</script>" for s in strings]
    assert records(spark, pages) == [(k, s, [[1, 2], [3]]) for k, s in enumerate(strings)]


def test_embedded_json_over_lines_undefined_and_broken(spark):
    pages = ['data = [\n {"a": undefined,\n "b": [[1],\n []]},\n {"a": "undefined", "b": undefined}\n]', 'data = [{"a": "x"', "nothing", 'data = {"a": "one", "b": []} ]', None, 'data = []']
    assert records(spark, pages) == [(0, None, [[1], []]), (0, "undefined", None), (3, "one", [])]


def test_wide_csv_files_have_their_own_headers(spark, tmp_path):
    for k, text in enumerate(["id,off.x\n1,2\n", "off.x,id\n2,20\n", "id,more\n3,y\n"]):
        (tmp_path / f"{k}.csv").write_text(text)
    got = io.read_wide_csv(spark, [str(tmp_path)], {"off.x": "x"})
    assert sorted((r["id"], r["x"], r["more"]) for r in got.collect()) == [("1", "2", None), ("20", "2", None), ("3", None, "y")]
