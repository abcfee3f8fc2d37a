"""A keyed target in buckets with a manifest: a batch rewrites the buckets that its keys fall into and leaves every other file as it is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTarget:
    """A Parquet table with at most one row per key, held in ``buckets`` folders by a hash of the key.

    ``folder/manifest/epoch=N`` names each bucket's folder and is complete when its ``_SUCCESS`` is there, so a batch that dies leaves the version
    before it as it was, and its files are not read. An epoch that is already in the manifest changes nothing, which makes a stream's repeated
    batch harmless. There is one writer at a time. Choose ``buckets`` so that one of them is a few hundred MB: a bucket is written by one task.
    NULL keys are keys like others.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.empty = spark.createDataFrame([], schema)

    def _glob(self, pattern: str) -> list:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        return [s.getPath() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]

    def epochs(self) -> list[int]:
        """Epochs that are complete, ascending."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._glob(f"{self.folder}/manifest/epoch=*/_SUCCESS"))

    def manifest(self, epoch: int | None = None) -> dict[int, str]:
        """Bucket to folder: at most ``buckets`` entries."""
        done = self.epochs()
        if epoch is None and not done:
            return {}
        rows = self.spark.read.schema("bucket int, path string").parquet(f"{self.folder}/manifest/epoch={done[-1] if epoch is None else epoch}")
        return {r["bucket"]: r["path"] for r in rows.collect()}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def read(self, epoch: int | None = None) -> DataFrame:
        """The newest version, or that of an epoch."""
        return self._read(list(self.manifest(epoch).values()))

    def apply(self, batch: DataFrame, epoch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merges a batch: ``merge(rows of the touched buckets, batch)`` gives their new rows. Returns the buckets that were rewritten."""
        done = self.epochs()
        if done and epoch <= done[-1]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        held = self.manifest()
        touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())  # numbers of buckets
        paths = dict(held)
        if touched:
            name = f"{self.folder}/data/{uuid.uuid4().hex}"
            merged = merge(self._read([held[b] for b in touched if b in held]), batch).select(*self.empty.columns)
            merged.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(name)
            written = [int(p.getName().split("=")[1]) for p in self._glob(f"{name}/_bucket=*")]  # a bucket without rows has no folder
            paths = {b: p for b, p in held.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in written}
        self.spark.createDataFrame(sorted(paths.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/epoch={epoch}")
        return touched

    def sink(self, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function; the batch is read more than once, so it is kept while it is merged."""

        def run(batch: DataFrame, epoch: int) -> None:
            kept = batch.persist()
            self.apply(kept, epoch, merge)
            kept.unpersist()

        return run
