"""Bucketed targets: untouched files stay, repeated epochs change nothing, merges equal the whole-table operators."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lineup.operators.extras import upsert_partial
from lineup.operators.sets import merge_lifecycle, upsert, upsert_coalesce
from lineup.sources.targets import BucketTarget

SCHEMA = "k long, s string, v double"


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("data/**/*.parquet")}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = BucketTarget(spark, str(tmp_path), SCHEMA, ["k"], buckets=16)
    first = spark.createDataFrame([(k, "a", float(k)) for k in range(400)], SCHEMA)
    replace = lambda old, new: upsert(old, new, ["k"], F.desc("v"))
    assert t.read().collect() == [] and t.apply(first, 0, replace) == list(range(16))
    before, paths = _files(tmp_path), t.manifest()
    batch = spark.createDataFrame([(7, "b", 1.0), (7, "b", 2.0), (1000, "n", 3.0)], SCHEMA)
    touched = t.apply(batch, 1, replace)
    assert len(touched) <= 2
    after = t.manifest()
    assert {b for b in after if after[b] != paths.get(b)} == set(touched)
    assert before.items() <= _files(tmp_path).items()
    assert _rows(t.read()) == _rows(replace(first, batch)) and t.read().count() == 401
    assert _rows(t.read(0)) == _rows(first)  # a reader of the version before is not disturbed
    names = set(_files(tmp_path))
    assert t.apply(batch.withColumn("v", F.lit(99.0)), 1, replace) == [] and set(_files(tmp_path)) == names and _rows(t.read()) == _rows(replace(first, batch))


def test_a_batch_that_dies_leaves_the_version_before(spark, tmp_path):
    t = BucketTarget(spark, str(tmp_path), SCHEMA, ["k"], buckets=4)
    t.apply(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), 0, lambda old, new: old.unionByName(new))

    def broken(old, new):
        return new.withColumn("v", F.raise_error(F.lit("lost")).cast("double"))

    with pytest.raises(Exception):
        t.apply(spark.createDataFrame([(1, "b", 2.0)], SCHEMA), 1, broken)
    assert t.epochs() == [0] and _rows(t.read()) == [(1, "a", 1.0)]
    t.apply(spark.createDataFrame([(1, "b", 2.0)], SCHEMA), 1, lambda old, new: new)
    assert _rows(t.read()) == [(1, "b", 2.0)]


def test_merges_are_those_of_the_whole_table(spark, tmp_path):
    old = spark.createDataFrame([(k if k else None, "a", None if k % 3 == 0 else float(k)) for k in range(60)], SCHEMA)
    new = spark.createDataFrame([(k, "b", float(-k)) for k in range(30, 90)], SCHEMA)
    for n, merge in enumerate((lambda a, b: upsert_coalesce(a, b, ["k"], ["v"]), lambda a, b: upsert_partial(a, b, ["k"], ["v"], {"s": "new"}))):
        t = BucketTarget(spark, str(tmp_path / str(n)), SCHEMA, ["k"], buckets=8)
        t.apply(old, 0, lambda a, b: a.unionByName(b))
        t.apply(new, 1, merge)
        assert _rows(t.read()) == _rows(merge(old, new).select("k", "s", "v"))
        t.apply(new.limit(0), 2, merge)
        assert t.epochs() == [0, 1, 2] and _rows(t.read()) == _rows(merge(old, new).select("k", "s", "v"))


def test_a_bucket_may_run_empty(spark, tmp_path):
    t = BucketTarget(spark, str(tmp_path), SCHEMA, ["k"], buckets=2)
    rows = spark.createDataFrame([(k, "a", 1.0) for k in range(10)], SCHEMA)
    t.apply(rows, 0, lambda a, b: b)
    t.apply(rows, 1, lambda a, b: a.limit(0))
    assert t.manifest() == {} and t.read().collect() == []


def test_stream_into_buckets(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([(k % 20, ["Entered", "Committed"][k % 2], float(k)) for k in range(100)], SCHEMA)
    rows.repartition(5).write.parquet(src)
    t = BucketTarget(spark, str(tmp_path / "target"), SCHEMA, ["k"], buckets=4)
    fold = lambda df: merge_lifecycle(df, ["k"], "s", ["Entered", "Committed"], ["v"])
    for _ in range(2):  # the second start finds nothing new
        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(src).writeStream.foreachBatch(t.sink(lambda a, b: fold(a.unionByName(b)))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert len(t.epochs()) >= 2 and _rows(t.read()) == _rows(fold(rows).select("k", "s", "v"))
