"""Streams with state against their batch twins, with rows that come late."""

from pyspark.sql import functions as F

from lineup.operators.extras import sessionize
from lineup.operators.sets import dedup_window
from lineup.streaming import stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"


def arriving(spark, tmp_path, files=3):
    """The events in several batches; a third of each batch is as old as the batch before, and a last row far ahead closes everything."""
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", "event_type", "value")
    span = batch.agg(F.min("ts").cast("long").alias("lo"), F.max("ts").cast("long").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / files + 1
    part = F.floor((F.col("ts").cast("long") - span["lo"]) / step) + F.when(F.xxhash64("event_id") % 3 == 0, 1).otherwise(0)
    rows = batch.withColumn("part", part).cache()
    for k in range(files + 1):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(span["hi"] + 10_000_000)).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    ahead.select(*[F.col(c).cast(t) for c, t in batch.dtypes]).write.parquet(f"{tmp_path}/in/{files + 1}")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return batch, stream, f"{int(2 * step / 3600) + 2} hours"


def test_sessions_end_by_boundary_or_gap(spark, tmp_path):
    batch, stream, late = arriving(spark, tmp_path)
    ends = F.col("event_type") == "purchase"
    got = stateful.run_available(stateful.boundary_sessions(stream, "user_id", "ts", "event_id", 4 * 3600, ends, late), f"{tmp_path}/q").where("user_id >= 0")
    want = sessionize(batch, "user_id", "ts", "event_id", 4 * 3600, ends).groupBy("user_id", "session").agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"), F.count("*").alias("events")).drop("session")
    a, b = (sorted(map(tuple, df.select("user_id", "first", "last", "events").collect())) for df in (got, want))
    assert a == b and len(a) > 100


def test_every_event_is_kept_or_a_duplicate(spark, tmp_path):
    batch, stream, late = arriving(spark, tmp_path)
    got = stateful.run_available(stateful.dedup_with_duplicates(stream, "user_id", "ts", "value", "event_id", 14, late), f"{tmp_path}/q").where("user_id >= 0")
    kept = {(r["user_id"], r["event_id"], r["bucket"]) for r in dedup_window(batch, "user_id", "ts", "value", "event_id").collect()}
    assert {(r["user_id"], r["event_id"], r["bucket"]) for r in got.where("kept").collect()} == kept
    assert got.count() == batch.count() and got.select("event_id").distinct().count() == batch.count()


def test_only_a_later_rebuild_clears(spark, tmp_path):
    rows = [(1, "out", 10), (1, "new", 5), (2, "out", 10), (2, "new", 20), (3, "new", 9), (4, "other", 1), (2, "out", 15), (5, "out", 3), (5, "new", 3)]
    events = spark.createDataFrame(rows, "k long, what string, s long").withColumn("ts", F.timestamp_seconds("s"))
    gone, built = F.col("what") == "out", F.col("what") == "new"
    profiles = spark.createDataFrame([(k,) for k in range(1, 7)], "k long")
    want = {r["k"]: (r["stale"], r["reason"], list(r["affected"])) for r in stateful.staleness(events, profiles, "k", "ts", gone, built, F.col("what"), ["fit", "gap"]).collect()}
    assert want == {1: (True, "out", ["fit", "gap"]), **{k: (False, None, []) for k in range(2, 7)}}
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.run_available(stateful.staleness_stream(stream, "k", "ts", gone, built, F.col("what")), f"{tmp_path}/q", "update")
    last = out.groupBy("k").agg(F.max_by("stale", "batch").alias("stale"), F.max_by(F.struct("reason"), "batch").alias("r"))
    assert {r["k"]: (r["stale"], r["r"]["reason"]) for r in last.collect()} == {k: want[k][:2] for k in (1, 2, 3, 5)}
