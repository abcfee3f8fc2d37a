"""Structured Streaming feeds; each has a batch twin among the operators.

State is bounded by watermarks; upserts write a new version of a Parquet target per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.operators.sets import merge_lifecycle, upsert_coalesce


def dedup_stream(events: DataFrame, key: str, ts: str, confidence: str, days: int = 14, late: str = "1 day") -> DataFrame:
    """X01 as a stream: the most confident event per key and tumbling bucket (aligned to 2020-01-01), emitted when the watermark closes it; ties to the earliest."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    best = F.max(F.struct(F.col(confidence), (-F.unix_micros(ts)).alias("minus"), F.struct(*events.columns).alias("row"))).alias("best")
    grouped = events.withWatermark(ts, late).groupBy(F.col(key).alias("_key"), F.window(ts, f"{days} days", startTime=f"{18262 % days} days")).agg(best)
    return grouped.select("best.row.*", F.col("window.start").alias("bucket_start"))


def session_stream(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """X05 as a stream: event counts and span of sessions that end after a gap."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap)).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def stale_stream(events: DataFrame, profiles: DataFrame, key: str, condition: Column) -> DataFrame:
    """Profiles whose entity has a departure event, as a stream joined with a static table."""
    return events.where(condition).select(F.col(key)).join(profiles, key).withColumn("stale", F.lit(True))


def lifecycle_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], status: str, order: list[str], first: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds each batch by stage and merges it into the target; late rows fill, never erase."""

    def apply(batch: DataFrame, epoch: int) -> None:
        folded = merge_lifecycle(batch, keys, status, order, first)
        write(upsert_coalesce(read(), folded.select(*read().columns), keys, keep=first))

    return apply


def monotone_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, flag: str, condition: Column) -> Callable[[DataFrame, int], None]:
    """A flag that only turns on."""

    def apply(batch: DataFrame, epoch: int) -> None:
        on = batch.where(condition).select(key).distinct().withColumn("_on", F.lit(True))
        write(read().join(on, key, "left").withColumn(flag, F.col(flag) | F.coalesce("_on", F.lit(False))).drop("_on"))

    return apply


def propagate_staleness(events: DataFrame, profiles: DataFrame, key: str, condition: Column, rebuilt: DataFrame | None = None) -> DataFrame:
    """X04, batch twin of ``stale_stream``: profiles with ``stale`` set where their entity had a departure, and cleared for those that were rebuilt."""
    gone = events.where(condition).select(key).distinct().withColumn("_gone", F.lit(True))
    out = profiles.join(gone, key, "left")
    if rebuilt is not None:
        out = out.join(rebuilt.select(key).distinct().withColumn("_new", F.lit(True)), key, "left")
    fresh = F.coalesce("_new", F.lit(False)) if rebuilt is not None else F.lit(False)
    return out.withColumn("stale", F.coalesce("_gone", F.lit(False)) & ~fresh).drop("_gone", "_new")


def classify_sink(gate: Column, event: Column, write: Callable[[str, DataFrame], None], threshold: float) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every text to the log with its verdict, kept and classified ones to staging, sure ones to the canonical table."""

    def apply(batch: DataFrame, epoch: int) -> None:
        seen = batch.withColumns({"gate": gate, "found": event})
        write("log", seen)
        kept = seen.where(F.col("gate.kept") & (F.col("found.event") != "unknown"))
        write("staging", kept)
        write("canonical", kept.where(F.col("found.confidence") >= threshold))

    return apply
