"""Queries that run streams with state over the events, which arrive out of order; their twins see all events at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators.sets import merge_lifecycle
from lineup.plans.base import Registry, table
from lineup.sources import io
from lineup.sources.targets import BucketTarget
from lineup.streaming import stateful

R = Registry()
_FILES = 3


def _arriving(spark, d):
    """The events in files of three spans of time, a third of each a span late, and a row far ahead that lets the watermark pass all others; and the watermark's delay."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    span = events.agg(F.min("ts").cast("long").alias("lo"), F.max("ts").cast("long").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    step = (hi - lo) / _FILES + 1
    part = F.floor((F.col("ts").cast("long") - lo) / step) + F.when(F.xxhash64("event_id") % 3 == 0, 1).otherwise(0)
    folder = io.new_folder(spark, "arriving")
    rows = events.withColumn("part", part)
    for k in range(_FILES + 1):
        rows.where(F.col("part") == k).drop("part").write.parquet(f"{folder}/in/{k}")
    ahead = spark.range(1).select(F.lit(-1).alias("event_id"), F.lit(-1).alias("user_id"), F.timestamp_seconds(F.lit(hi + 10_000_000)).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    ahead.select(*[F.col(c).cast(t) for c, t in events.dtypes]).write.parquet(f"{folder}/in/{_FILES + 1}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    return stream, f"{int(2 * step / 3600) + 2} hours", folder


@R("X05b_session_stream", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) > 14400 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS events FROM s GROUP BY user_id, session""")
def x05b(spark, d):
    """Sessions that end with a purchase or before four hours without an event."""
    stream, late, folder = _arriving(spark, d)
    sessions = stateful.boundary_sessions(stream, "user_id", "ts", "event_id", 14400, F.col("event_type") == "purchase", late)
    return stateful.run_available(sessions, folder).where("user_id >= 0").select("user_id", "first", "last", "events")


@R("X01b_dedup_stream", """SELECT user_id, event_id, bucket, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, ts, event_id) = 1 AS kept
FROM (SELECT *, floor(date_diff('day', DATE '2020-01-01', ts::DATE) / 14)::BIGINT AS bucket FROM events)""")
def x01b(spark, d):
    """Every event of a stream, kept or a duplicate of a more confident one of its fortnight."""
    stream, late, folder = _arriving(spark, d)
    rows = stateful.dedup_with_duplicates(stream, "user_id", "ts", "value", "event_id", 14, late)
    return stateful.run_available(rows, folder).where("user_id >= 0").select("user_id", "event_id", "bucket", "kept")


_OUTPUTS = ["scheme_fit", "gap_match", "team_rating", "playing_time"]


@R("X04b_staleness_stream", f"""WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS gone, max(ts) FILTER (WHERE event_type = 'signup') AS built FROM events GROUP BY 1),
s AS (SELECT c_custkey, coalesce(gone > built OR (gone IS NOT NULL AND built IS NULL), false) AS stale FROM customer LEFT JOIN l ON user_id = c_custkey)
SELECT c_custkey, stale, CASE WHEN stale THEN 'error' END AS reason, CASE WHEN stale THEN '{",".join(_OUTPUTS)}' ELSE '' END AS affected FROM s""")
def x04b(spark, d):
    """A stream of errors and signups marks profiles; a signup clears only what is older. Readers get the reason and the outputs that are affected."""
    stream, _, folder = _arriving(spark, d)
    departure, rebuild = F.col("event_type") == "error", F.col("event_type") == "signup"
    seen = stateful.run_available(stateful.staleness_stream(stream, "user_id", "ts", departure, rebuild, F.col("event_type")), folder, "update")
    last = seen.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by(F.struct("stale", "reason"), "batch").alias("s"))
    return stateful.with_affected(table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "s.stale", "s.reason"), _OUTPUTS).select("c_custkey", "stale", "reason", F.array_join("affected", ",").alias("affected"))


@R("X03b_lifecycle_buckets", "SELECT o_custkey, list_extract(['O', 'P', 'F'], max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END)) AS o_orderstatus, epoch_us(min(o_orderdate)::TIMESTAMP) AS first FROM orders GROUP BY 1")
def x03b(spark, d):
    """Orders as a stream of files, each batch folded by stage into the buckets that its customers are in."""
    folder, files = io.new_folder(spark, "lifecycle"), 6
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("first"))
    o.repartition(files).write.parquet(f"{folder}/in")
    target = BucketTarget(spark, f"{folder}/target", o.schema, ["o_custkey"], buckets=16)
    fold = target.sink(lambda held, new: merge_lifecycle(held.unionByName(new), ["o_custkey"], "o_orderstatus", ["O", "P", "F"], ["first"]))
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", files // 3).parquet(f"{folder}/in")
    run = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return target.read()
