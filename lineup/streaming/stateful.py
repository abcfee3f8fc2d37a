"""Streams with state of their own, by ``transformWithState`` and event-time timers. Each has a batch twin.

State holds what the watermark has not passed yet and one open record a key. They need the RocksDB state store (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that these streams need; the session's own is set again afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class _InOrder(StatefulProcessor):
    """Rows of a key, handed on in the order of time as soon as the watermark has passed them."""

    row = "us long, id long, ends boolean"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.start(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a message to the JVM, so a batch's rows go in one
        new = [(int(us), int(i), bool(e)) for pdf in rows for us, i, e in zip(pdf["us"].tolist(), pdf["id"].tolist(), pdf["ends"].tolist())]
        if new:
            self.waiting.appendList(new)
        least = min((r[0] for r in new), default=None)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        out, again = self.passed(due, mark)
        again = min([x for x in (again, later[0][0] // 1000 + 1 if later else None) if x is not None], default=None)
        if again is not None and again > mark // 1000:
            self.handle.registerTimer(again)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


class _Sessions(_InOrder):
    def __init__(self, columns: list[str], gap: int):
        self.columns, self.gap = columns, gap

    def start(self, handle) -> None:
        self.open = handle.getValueState("open", "first long, last long, n long")

    def passed(self, due: list, mark: int):
        held = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for us, _, ends in due:
            if held and us // 1_000_000 - held[1] // 1_000_000 > self.gap:
                out.append(held)
                held = None
            held = (held[0], us, held[2] + 1) if held else (us, us, 1)
            if ends:
                out.append(held)
                held = None
        if held and mark // 1_000_000 - held[1] // 1_000_000 > self.gap:  # nothing that is still to come belongs to it
            out.append(held)
            held = None
        self.open.update(held) if held else self.open.clear()
        return out, (held[1] // 1_000_000 + self.gap + 1) * 1000 + 1 if held else None


def boundary_sessions(events: DataFrame, key: str, ts: str, tie: str, gap: int, boundary: Column, late: str = "1 hour") -> DataFrame:
    """X05 as a stream: ``key, first, last`` (microseconds) and ``events`` of each session, which ends with a boundary event or before a gap of more than ``gap`` seconds.

    Events are taken in order of time, ties by ``tie``, once the watermark has passed them; a session is returned when nothing can join it any more.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(key, ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("id"), F.coalesce(boundary, F.lit(False)).alias("ends"))
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(_Sessions([key, "first", "last", "events"], gap), f"{key} {kind}, first long, last long, events long", "Append", "EventTime")


class _Buckets(StatefulProcessor):
    """The best row of each bucket of a key; others are returned as duplicates when they lose, the best when the bucket closes."""

    def __init__(self, columns: list[str], days: int):
        self.columns, self.width = columns, days * 86_400_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "bucket long, score double, us long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a key's buckets are read once a batch and written once
        stored = self._stored()
        lost, held = [], dict(stored)
        for pdf in rows:
            for us, i, score, bucket in zip(*(pdf[c].tolist() for c in ("us", "id", "score", "bucket"))):
                bucket, new = int(bucket), (float(score), int(us), int(i))
                old = held.get(bucket)
                if old is None or (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
                    held[bucket], new = new, old
                if old is not None:
                    lost.append((*key, new[2], bucket, False))
        if held != stored:
            self.best.put([(bucket, *v) for bucket, v in held.items()])
        for bucket in held.keys() - stored.keys():
            self.handle.registerTimer(self._end(bucket))
        if lost:
            yield pd.DataFrame(lost, columns=self.columns)

    def _stored(self) -> dict:
        return {int(r[0]): (float(r[1]), int(r[2]), int(r[3])) for r in self.best.get()}

    def _end(self, bucket: int) -> int:
        return (18262 * 86_400_000_000 + (bucket + 1) * self.width) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = self._stored()
        closed = [(bucket, v) for bucket, v in held.items() if self._end(bucket) <= mark]
        later = [(bucket, *v) for bucket, v in held.items() if self._end(bucket) > mark]
        if closed:
            self.best.put(later) if later else self.best.clear()
        if closed:
            yield pd.DataFrame([(*key, v[2], bucket, True) for bucket, v in closed], columns=self.columns)

    def close(self) -> None:
        pass


def dedup_with_duplicates(events: DataFrame, key: str, ts: str, confidence: str, tie: str, days: int = 14, late: str = "1 day") -> DataFrame:
    """X01 as a stream: every event with ``bucket`` and ``kept``: of a key's events in one bucket of days (aligned to 2020-01-01) the most confident, ties the earliest.

    Duplicates are returned as soon as they have lost, the kept ones when the watermark has closed their bucket.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bucket = F.floor((F.unix_micros(ts) - 18262 * 86_400_000_000) / (days * 86_400_000_000)).cast("long")
    rows = rows.select(key, ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("id"), F.col(confidence).cast("double").alias("score"), bucket.alias("bucket"))
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(_Buckets([key, tie, "bucket", "kept"], days), f"{key} {kind}, {tie} long, bucket long, kept boolean", "Append", "EventTime")


class _Staleness(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "gone long, built long, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.seen.get()) if self.seen.exists() else (None, None, None)
        gone, built, reason = old
        for pdf in rows:
            for r in pdf[["us", "rebuild", "reason"]].itertuples(index=False):
                us = int(r.us)
                if r.rebuild:
                    built = us if built is None else max(built, us)
                elif gone is None or (us, r.reason) > (gone, reason):
                    gone, reason = us, r.reason
        self.seen.update((gone, built, reason))
        stale = gone is not None and (built is None or gone > built)
        yield pd.DataFrame([(*key, stale, reason if stale else None, max(x for x in (gone, built) if x is not None))], columns=self.columns)

    def close(self) -> None:
        pass


def staleness_stream(events: DataFrame, key: str, ts: str, departure: Column, rebuild: Column, reason: Column) -> DataFrame:
    """X04 as a stream: per key and batch ``stale, reason, as_of``: whether its last departure is later than its last rebuild, whatever order they arrive in."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).where(departure | rebuild)
    rows = rows.select(key, F.unix_micros(ts).alias("us"), rebuild.alias("rebuild"), reason.cast("string").alias("reason"))
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(_Staleness([key, "stale", "reason", "as_of"]), f"{key} {kind}, stale boolean, reason string, as_of long", "Update", "None")


def staleness(events: DataFrame, profiles: DataFrame, key: str, ts: str, departure: Column, rebuild: Column, reason: Column, affected: list[str]) -> DataFrame:
    """X04, batch twin: every profile with ``stale``, the ``reason`` of its last departure and the ``affected`` outputs; only a later rebuild clears it."""
    last = events.withColumn(ts, F.unix_micros(F.col(ts).cast("timestamp"))).groupBy(key).agg(
        F.max(F.when(departure, F.struct(F.col(ts).alias("us"), reason.cast("string").alias("reason")))).alias("_gone"), F.max(F.when(rebuild, F.col(ts))).alias("_built")
    )
    stale = F.col("_gone").isNotNull() & (F.col("_built").isNull() | (F.col("_gone.us") > F.col("_built")))
    return with_affected(profiles.join(last, key, "left").withColumn("stale", stale).withColumn("reason", F.col("_gone.reason")).drop("_gone", "_built"), affected)


def with_affected(profiles: DataFrame, affected: list[str]) -> DataFrame:
    """X04, what readers get: ``stale`` (false where nothing was seen), ``reason`` and the ``affected`` outputs of stale profiles only."""
    known = F.coalesce("stale", F.lit(False))
    listed = F.when(known, F.array(*[F.lit(a) for a in affected])).otherwise(F.array().cast("array<string>"))
    return profiles.withColumns({"reason": F.when(known, F.col("reason")), "affected": listed}).withColumn("stale", known)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote (``update``: with ``batch``, the number of the batch)."""
    spark = stream.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        df.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")  # a repeated batch writes the same folder

    with state_store(spark):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
