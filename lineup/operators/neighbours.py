"""Exact nearest neighbours with an index of pivot cells.

``PIVOTS`` points, chosen by a hash of the key, are pivots; every point lies in the cell of its nearest pivot and keeps its distance to it. A target first
reads the nearest cells that hold ``n`` points, which bounds its ``n``-th distance; then it reads only the cells that can hold something nearer: by the triangle
inequality a point at distance ``a`` from its pivot is at least ``|d - a|`` from a target at distance ``d`` from that pivot, and a point of a cell is at
least half the difference of the target's distances to that cell's pivot and to its nearest one away. Inside a cell, points lie in order of ``a``, and only those
within the bound are compared. Large cells are dealt to tasks by a hash of the key, so no task holds more than about ``CELL`` points.

Points and targets whose vector is NULL, holds a NULL or NaN, or has another length than most pivots' take no part. Ties go to the smaller key.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.sources.io import stage

PIVOTS, CELL = 128, 20_000


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``y``, by plain differences, some rows of ``x`` at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for k in range(0, len(x), step):
        out[k : k + step] = np.sqrt(((x[k : k + step, None, :] - y[None]) ** 2).sum(axis=2))
    return out


def _nearest(dist: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest (distance, key)."""
    if len(dist) > 4 * n:
        near = np.flatnonzero(dist <= np.partition(dist, n - 1)[n - 1])
        return near[np.lexsort((keys[near], dist[near]))[:n]]
    return np.lexsort((keys, dist))[:n]


class Index:
    """Pivots, and of each cell how many points it has and how far they lie from its pivot."""

    def __init__(self, points: DataFrame, key: str, vector: str):
        fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & (F.size(vector) > 0) & F.col(key).isNotNull()
        rows = points.where(fine).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        some = rows.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).collect()
        lengths = Counter(len(r["v"]) for r in some)
        self.width = max(lengths, key=lambda k: (lengths[k], k), default=0)
        same = [r["v"] for r in some if len(r["v"]) == self.width]
        self.pivots = np.array(same).reshape(len(same), self.width)
        self.fine, self.type = rows.where(F.size("v") == self.width), dict(rows.dtypes)["key"]
        self.points = stage(self._placed(), "cells") if len(self.pivots) else None
        self.n, self.low, self.high = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots)), np.zeros(len(self.pivots))
        if self.points is not None:
            for r in self.points.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():
                self.n[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]

    def _placed(self) -> DataFrame:
        pivots, width = self.pivots, self.width

        def run(batches):
            for b in batches:
                if b.num_rows:
                    d = _distances(_rows(b.column(1), width), pivots)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["key", "v", "cell", "away"])

        return self.fine.mapInArrow(run, f"key {self.type}, v array<double>, cell int, away double")

    def visits(self, targets: DataFrame, n: int, bounded: bool) -> DataFrame:
        """``target, w, bound, cell, away``: the cells that a target (``target, w``, with ``bounded`` also ``bound``) reads, without a bound the first ones."""
        pivots, width, count, low, high = self.pivots, self.width, self.n, self.low, self.high
        kind = self.type

        def first(d: np.ndarray) -> np.ndarray:
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(count[order], axis=1)
            take = np.concatenate([np.ones((len(d), 1), bool), held[:, :-1] < n + 1], axis=1)  # one of the points may be the target itself
            out = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(out, order, take, axis=1)
            return out & (count > 0)

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                d = _distances(_rows(b.column(1), width), pivots)
                read = first(d)
                bound = np.full(len(d), np.inf)
                if bounded:
                    bound = b.column(2).to_numpy()
                    least = np.maximum(np.maximum(d - high, low - d), (d - d.min(axis=1, keepdims=True)) / 2)
                    read = ~read & (count > 0) & (least <= bound[:, None] * (1 + 1e-9) + 1e-12)
                i, c = np.nonzero(read)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(bound[i]), pa.array(c.astype(np.int32)), pa.array(d[i, c])], names=["target", "w", "bound", "cell", "away"])

        rows = targets.select("target", "w", *(["bound"] if bounded else []))
        return rows.mapInArrow(run, f"target {kind}, w array<double>, bound double, cell int, away double")

    def search(self, visits: DataFrame, n: int) -> DataFrame:
        """``target, key, distance``: of each target and task the ``n`` nearest points of the cells that it reads."""
        width, kind = self.width, self.type
        parts = [max(1, -(-int(c) // CELL)) for c in self.n]
        of = F.get(F.array(*[F.lit(p) for p in parts]), F.col("cell"))
        points = self.points.withColumn("part", F.pmod(F.xxhash64("key"), of).cast("int"))
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), of - 1)))

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            found = [[], [], []]
            if x.num_rows and y.num_rows:
                keys, p, away = y.column("key").to_numpy(), _rows(y.column("v"), width), y.column("away").to_numpy()
                order = np.argsort(away, kind="stable")
                keys, p, away = keys[order], p[order], away[order]
                own, w = x.column("target").to_pylist(), _rows(x.column("w"), width)
                for t, v, bound, d in zip(own, w, x.column("bound").to_pylist(), x.column("away").to_pylist(), strict=True):
                    slack = bound * (1 + 1e-9) + 1e-12
                    lo, hi = np.searchsorted(away, [d - slack, d + slack], side="left") if np.isfinite(bound) else (0, len(away))
                    hi = len(away) if not np.isfinite(bound) else int(np.searchsorted(away, d + slack, side="right"))
                    k = keys[lo:hi]
                    dist = np.sqrt(((p[lo:hi] - v) ** 2).sum(axis=1))
                    dist[k == t] = np.inf
                    at = _nearest(dist, k, n)
                    at = at[np.isfinite(dist[at])]
                    found[0] += [t] * len(at)
                    found[1] += k[at].tolist()
                    found[2] += dist[at].tolist()
            kinds = (x.schema.field("target").type, y.schema.field("key").type, pa.float64())
            return pa.table([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=["target", "key", "distance"])

        return visits.groupBy("cell", "part").cogroup(points.groupBy("cell", "part")).applyInArrow(run, f"target {kind}, key {kind}, distance double")


def _best(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("target").orderBy("distance", "key")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def knn(points: DataFrame, targets: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """``target, key, distance, place``: the ``n`` nearest points of each target by Euclidean distance, itself excluded."""
    index = Index(points, key, vector)
    if index.points is None:
        return points.select(F.col(key).alias("target"), F.col(key), F.lit(0.0).alias("distance"), F.lit(0).alias("place")).limit(0)
    t = targets.select(F.col(key).alias("target"), F.col(vector).cast("array<double>").alias("w"))
    t = t.where(F.col("target").isNotNull() & (F.size("w") == index.width) & ~F.exists("w", lambda x: x.isNull() | F.isnan(x))).dropDuplicates(["target"])
    first = stage(_best(index.search(index.visits(t, n, False), n), n), "near")
    bounds = first.where(F.col("place") == n).select("target", F.col("distance").alias("bound"))
    bounded = t.join(bounds, "target", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = index.search(index.visits(bounded, n, True), n)
    return _best(first.select("target", "key", "distance").unionByName(rest), n).select("target", F.col("key").alias(key), "distance", "place")
