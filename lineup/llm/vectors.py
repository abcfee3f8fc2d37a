"""Operators 1 and 2: nearest neighbours of a stated query set, by block matrix joins.

Queries (rows whose id is divisible by ``every``) and candidates are dealt to a grid of cells; each cell holds a bounded share of
both sides, every pair of a query and a candidate meets in exactly one cell, and a cell returns the best ``k`` of each of
its queries. The lists of the cells are merged by rank.

Operator 1 (cosine): unit vectors are quantised to int8 with a scale per vector; the product of two int8 tiles plus the norms of
the quantisation residuals bounds each cosine from both sides, and only pairs whose upper bound reaches the
query's current k-th best are recomputed in double precision and pushed on the query's heap. No neighbour is lost.

Operator 2 (integer inner product): vectors are turned to the principal axes of the cell's candidates, which changes no distance. Means and
deviations of segments of the turned dimensions, coarse to fine (``_edges``), give a lower bound of each distance and so an upper
bound of each product; exact products of the original whole components are computed for survivors only. Where a product
could leave the whole numbers that doubles hold, the survivors are computed in Python's integers; pairs with a component of ``WILD`` or more, for which the
bounds could overflow, are all computed in them; a returned score beyond a bigint is an error.

Operator 1 first scales each vector by a power of two to a largest component of 0.5 to 1, which changes no cosine and keeps squares in range.

Rows take no part if the vector is null, empty, or holds null or non-finite components (operator 1: also zero vectors). Vectors of different length are never compared. Ids are keys: a row never
meets a row of the same id, and of repeated ids the best score counts once. Ties go to the smaller id. Empty tables
give empty results; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a tile, and the most components (8 bytes each) of either side in a cell.
TILE_Q, TILE_C = 256, 2048
CELL_Q, CELL_C = 1_000_000, 4_000_000
#: Components of this size are left to whole numbers (operator 2).
WILD = 1e130
LEAST = -(1 << 63)


def _grid(spark, queries: tuple[int, int], rows: tuple[int, int]) -> tuple[int, int]:
    """Groups of queries and of candidates, from (rows, components) of each: bounded cells, at least a cell for each shuffle partition, little replication."""
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ratio = max(1.0, rows[0] / max(1, queries[0]))
    gq = max(math.ceil(queries[1] / CELL_Q), math.ceil(math.sqrt(want / ratio)), 1)
    return gq, max(math.ceil(rows[1] / CELL_C), math.ceil(want / gq), 1)


def _matrix(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and float64 rows of the usable vectors, by length."""
    ids = table.column("id").to_numpy()
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        at = lists.offsets.to_numpy()[rows]
        m = flat[at[:, None] + np.arange(d)]
        fine = np.isfinite(m).all(axis=1)
        if fine.any():
            out[int(d)] = ids[rows[fine]], m[fine]
    return out


def _near(score: int) -> float:
    """A whole number as a double, infinite beyond them."""
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


class Best:
    """The ``k`` best (score, smaller id) of each query, as heaps; ``floor`` is what a new score has to reach.

    ``repeated``: candidates may share an id, of which the best score is kept.
    """

    def __init__(self, n: int, k: int, repeated: bool = False):
        self.heaps, self.k, self.repeated = [[] for _ in range(n)], k, repeated
        self.floor = np.full(n, -np.inf)

    def _one(self, a: int, i: int, s) -> bool:
        heap = self.heaps[a]
        if self.repeated:
            for n, (old, own) in enumerate(heap):
                if own == -i:
                    if s > old:
                        heap[n] = (s, -i)
                        heapq.heapify(heap)
                    return len(heap) == self.k
        if len(heap) < self.k:
            heapq.heappush(heap, (s, -i))
        elif (s, -i) > heap[0]:
            heapq.heapreplace(heap, (s, -i))
        return len(heap) == self.k

    def push(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        if not self.repeated:
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < self.k
            q, ids, scores = q[keep], ids[keep], scores[keep]
        for a, i, s in zip(q.tolist(), ids.tolist(), scores.tolist(), strict=True):
            if self._one(a, i, s):
                self.floor[a] = self.heaps[a][0][0]

    def push_whole(self, q: np.ndarray, ids: np.ndarray, scores: list[int]) -> None:
        """As ``push`` for whole scores of any size, which are compared as they are."""
        for a, i, s in zip(q.tolist(), ids.tolist(), scores, strict=True):
            if self._one(a, i, s):
                self.floor[a] = np.nextafter(_near(self.heaps[a][0][0]), -np.inf)


def cosine_cell(qi, q, ci, c, best: Best) -> None:
    """Push each query's nearest candidates of one cell."""
    qn, cn = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))

    def quantised(x, norm):
        unit = x / norm[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        whole = np.rint(unit / scale[:, None])
        back = whole * scale[:, None]
        return whole.astype(np.int8), scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back * back).sum(axis=1))

    q8, qs, qr, qb = quantised(q, qn)
    c8, cs, cr, _ = quantised(c, cn)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # int8 products add up exactly in it
    for a in range(0, len(q), TILE_Q):
        rows = slice(a, a + TILE_Q)
        left = q8[rows].astype(exact)
        for b in range(0, len(c), TILE_C):
            cols = slice(b, b + TILE_C)
            tile = (left @ c8[cols].astype(exact).T).astype(np.float64) * qs[rows, None] * cs[None, cols]
            error = qb[rows, None] * cr[None, cols] + qr[rows, None] + 1e-9
            low, high = tile - error, tile + error
            same = qi[rows, None] == ci[None, cols]
            low[same], high[same] = -np.inf, -np.inf
            floor = best.floor[rows]
            if low.shape[1] >= best.k and not best.repeated:
                floor = np.maximum(floor, np.partition(low, -best.k, axis=1)[:, -best.k])
            i, j = np.nonzero((high >= floor[:, None]) & ~same)
            score = np.einsum("ij,ij->i", q[a + i], c[b + j]) / (qn[a + i] * cn[b + j])
            best.push(a + i, ci[b + j], score)


def _axes(x: np.ndarray) -> np.ndarray:
    """Principal axes of the rows (of at most 4,096 of them, evenly taken), largest variance first: an orthogonal turn, which changes no distance."""
    some = x[:: max(1, len(x) // 4096)]
    some = some / max(1.0, np.abs(some).max())
    some = some - some.mean(axis=0)
    return np.linalg.eigh(some.T @ some)[1][:, ::-1]


def _edges(d: int) -> list[np.ndarray]:
    """Segment borders of each level, coarse to fine: on a level a fourth, half, three fourths of the (turned) dimensions stand alone and
    the rest lies in four segments."""
    out = [np.unique(np.linspace(0, d, min(d, 4) + 1).astype(int))]
    for alone in (d // 4, d // 2, 3 * d // 4):
        if alone:
            out.append(np.unique(np.concatenate([np.arange(alone), np.linspace(alone, d, min(d - alone, 4) + 1).astype(int)])))
    return out


def _segments(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Means and deviations of each row's segments, weighted so that squared differences of rows add up to the bound."""
    size = np.diff(edge).astype(np.float64)
    mean = np.add.reduceat(x, edge[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edge[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    several = size > 1  # a segment of one dimension has no deviation
    return np.concatenate([mean * np.sqrt(size), deviation[:, several] * np.sqrt(size[several])], axis=1)


def _exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, safe: bool) -> list[int]:
    """Whole inner products of pairs of rows; ``safe``: all sums are whole numbers that doubles hold."""
    if safe:
        return np.einsum("ij,ij->i", q[i], c[j]).astype(np.int64).tolist()
    return [sum(int(v) * int(w) for v, w in zip(q[a], c[b], strict=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def product_cell(qi, q, ci, c, best: Best) -> int:
    """Push each query's candidates of largest integer product of one cell; the number of pairs that were computed exactly.

    A pair is left out where the product that its lower-bound distance allows stays under the query's k-th best, on the
    coarsest level that shows it. ``slack`` is more than the rounding of the bounds.
    """
    axes = _axes(c)
    turned_q, turned_c = q @ axes, c @ axes
    levels = [(_segments(turned_q, e), _segments(turned_c, e)) for e in _edges(q.shape[1])]
    q2, c2 = (q * q).sum(axis=1), (c * c).sum(axis=1)
    safe = bool(math.sqrt(q2.max() * c2.max()) < 1 << 52)
    tried = 0

    def survivors(a, b, i, j):
        nonlocal tried
        tried += len(i)
        best.push_whole(a + i, ci[b + j], _exact(q, c, a + i, b + j, safe))

    for a in range(0, len(q), TILE_Q):
        rows = slice(a, a + TILE_Q)
        for b in range(0, len(c), TILE_C):
            cols = slice(b, b + TILE_C)
            alive = qi[rows, None] != ci[None, cols]
            norms = q2[rows, None] + c2[None, cols]
            slack = 1e-12 * norms
            for n, (x, y) in enumerate(levels):
                x, y = x[rows], y[cols]
                bound = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)  # at most the squared distance
                high = np.where(alive, (norms - bound) / 2 + slack, -np.inf)
                if n + 1 == len(levels) and not np.isfinite(best.floor[rows]).all() and high.shape[1] > best.k:
                    # the heaps start with the most promising pairs
                    top = np.argpartition(high, -best.k, axis=1)[:, -best.k :]
                    i, j = np.repeat(np.arange(len(high)), best.k), top.ravel()
                    i, j = i[alive[i, j]], j[alive[i, j]]
                    survivors(a, b, i, j)
                    alive[i, j] = False
                alive &= high >= best.floor[rows, None]
                if not alive.any():
                    break
            i, j = np.nonzero(alive)
            survivors(a, b, i, j)
    return tried


def _whole_row(x: np.ndarray) -> list[int]:
    """``floor(256 x)`` as Python integers; a double of 2^60 or more is whole."""
    return [int(v) * 256 if abs(v) >= 1 << 60 else math.floor(256 * v) for v in x.tolist()]


def whole_cell(qi, q, ci, c, best: Best) -> None:
    """``product_cell`` of ``floor(256 x)``; pairs with a vector of huge components are computed in whole numbers, all of them."""
    wild_q, wild_c = np.abs(q).max(axis=1) >= WILD, np.abs(c).max(axis=1) >= WILD
    if wild_q.any() or wild_c.any():
        rows = {}
        for j in range(len(c)):
            own = _whole_row(c[j])
            for i in range(len(q)) if wild_c[j] else np.flatnonzero(wild_q).tolist():
                if qi[i] != ci[j]:
                    left = rows.setdefault(i, None) or _whole_row(q[i])
                    rows[i] = left
                    best.push_whole(np.array([i]), ci[j : j + 1], [sum(v * w for v, w in zip(left, own, strict=True))])
    tame_q, tame_c = np.flatnonzero(~wild_q), np.flatnonzero(~wild_c)
    if len(tame_q) and len(tame_c):
        rest = Best(len(tame_q), best.k, best.repeated)
        rest.heaps, rest.floor = [best.heaps[i] for i in tame_q.tolist()], best.floor[tame_q]
        product_cell(qi[tame_q], np.floor(256.0 * q[tame_q]), ci[tame_c], np.floor(256.0 * c[tame_c]), rest)


def _prepare_cosine(ids, x):
    largest = np.abs(x).max(axis=1)
    fine = largest > 0
    x = np.ldexp(x[fine], -np.frexp(largest[fine])[1][:, None])
    return ids[fine], x


def _as_is(ids, x):
    return ids, x


def top_k(df: DataFrame, prepare, cell, score: str, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best candidates."""
    spark = df.sparkSession
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    queries = rows.where(F.col("id") % every == 0)
    own, size = F.col("id") % every == 0, F.size("vector")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(own).alias("q"), F.sum(size).alias("nd"), F.sum(F.when(own, size)).alias("qd")).first()
    gq, gc = _grid(spark, (sizes["q"], sizes["qd"] or 0), (sizes["n"], sizes["nd"] or 0))
    place = F.pmod(F.xxhash64("id"), F.lit(gc)).cast("int")
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(gq)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(gc - 1))).alias("b"), "id", "vector")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(gq - 1))).alias("a"), place.alias("b"), "id", "vector")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [[], [], []]
        if x.num_rows and y.num_rows:
            xs, ys = _matrix(x, "vector"), _matrix(y, "vector")
            for d in xs.keys() & ys.keys():
                (qi, q), (ci, c) = prepare(*xs[d]), prepare(*ys[d])
                best = Best(len(qi), k, repeated=len(np.unique(ci)) < len(ci))
                if len(qi) and len(ci):
                    cell(qi, q, ci, c, best)
                for i, heap in zip(qi.tolist(), best.heaps, strict=True):
                    for s, v in heap:
                        for c_, v_ in zip(found, (i, -v, s), strict=True):
                            c_.append(v_)
        whole = score == "long"
        # a sum above a bigint is an error here; one below it may lose against others, so that only a returned one is an error
        scores = pa.array([max(int(s), LEAST) for s in found[2]] if whole else found[2], pa.int64() if whole else pa.float64())
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), scores], names=["query_id", "vec_id", "score"])

    got = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if score == "long":
        got = got.withColumn("score", F.when(F.col("score") == LEAST, F.raise_error(F.lit("a score is below the bigints")).cast("long")).otherwise(F.col("score")))
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score).alias("score"))


def nearest(df: DataFrame, **args) -> DataFrame:
    """Operator 1: largest cosine in double precision."""
    return top_k(df, _prepare_cosine, cosine_cell, "double", **args)


def largest_products(df: DataFrame, **args) -> DataFrame:
    """Operator 2: largest inner product of ``floor(256 * x)`` components."""
    return top_k(df, _as_is, whole_cell, "long", **args)


def query_nearest(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def query_products(spark, sf_dir):
    return largest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_SQL = """
WITH usable AS (SELECT vec_id, {vector} AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score FROM usable q JOIN usable c
  ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
SQL_NEAREST = _SQL.format(vector="CAST(embedding AS DOUBLE[])", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0", score="list_cosine_similarity(q.v, c.v)")
SQL_PRODUCTS = _SQL.format(vector="list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))", more="", score="CAST(list_inner_product(q.v, c.v) AS BIGINT)")
