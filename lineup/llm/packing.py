"""Operator 5: mixture-controlled packing.

Every source is a queue of token ids. Windows of ``length`` tokens are filled from all queues at target token proportions by deficit
round robin: on each window a queue is owed its proportion of the window plus the deficit that it carries, it gives the whole tokens of
that, and the rest is its deficit for the next window. The targets are an argument (a proportion per source; without it, the
corpus shares). When a queue runs dry, the others share its place in their own proportions; sources without a target, or with
target zero, follow when all others are dry, at their corpus shares, so nothing is left out.

What the queues have given before a window is a closed form of the window's number: shares are taken one queue after another from
what the earlier ones left, in whole numbers, so each queue's count never falls, all counts add up to the window's border,
and a deficit stays below the number of queues. So any task can cut its documents at the window borders, and deficits
carry across windows and partitions without a pass over the windows; ``mixture_report`` lists them. The last windows are powers of two, which need no padding.

Up to ``QUEUES`` sources (a row each comes to the driver) have queues of their own; beyond, sources without a target of their own share ``QUEUES``
queues by a hash of their name.

Rows with null text are empty documents and still give their end id; a null source is a queue of its own; repeated rows are
packed as often as they occur; an empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.llm.common import column, documents, materialize, small_batches, values_of
from lineup.llm.tokens import encoder, token_path, wide

LENGTH = 4096
END_ID = 2
#: A table of offsets up to this many rows (about 40 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Sources that have a queue of their own at most.
QUEUES = 10_000


class Mixture:
    """How many tokens each queue has given after the first K tokens of the output; ``weights`` are whole numbers, the totals without them."""

    def __init__(self, totals: list[int], length: int, weights: list[int] | None = None):
        self.totals, self.length, self.total = totals, length, sum(totals)
        self.whole = self.total // length
        self.tail = []
        at = self.whole * length
        for bit in range(length.bit_length(), -1, -1):
            if (self.total - self.whole * length) >> bit & 1:
                self.tail.append(at)
                at += 1 << bit
        self.windows = self.whole + len(self.tail)
        self.keep = max(16, 2_000_000 // max(1, len(totals)))
        self.seen: dict[int, list[int]] = {}
        self.weights = list(totals if weights is None else weights)
        self.phases = self._phases(self.weights)

    @staticmethod
    def _shares(left: int, weights: list[int]) -> list[int]:
        rest, got = sum(weights), []
        for w in weights:
            share = left * w // rest if rest else 0
            got.append(share)
            left, rest = left - share, rest - w
        return got

    def _phases(self, weights: list[int]) -> list[tuple[int, list[int], list[int]]]:
        """Where the set of queues that still give changes: tokens before it, what each queue has given, the weights from there on."""
        at, given, out = 0, [0] * len(weights), []
        while at < self.total:
            live = [w if g < n else 0 for w, g, n in zip(weights, given, self.totals, strict=True)]
            if not any(live):  # only queues without a target are left
                weights = [n - g for n, g in zip(self.totals, given, strict=True)]
                live = weights
            low, high = at, self.total  # the last place at which no queue has given more than it has
            while low < high:
                k = (low + high + 1) // 2
                over = any(g + s > n for g, s, n in zip(given, self._shares(k - at, live), self.totals, strict=True))
                low, high = (low, k - 1) if over else (k, high)
            out.append((at, given, live))
            given = [g + s for g, s in zip(given, self._shares(low - at, live), strict=True)]
            at = low
        return out

    def border(self, window: int) -> int:
        if window < self.whole:
            return window * self.length
        return self.tail[window - self.whole] if window < self.windows else self.total

    def given(self, window: int) -> list[int]:
        """Tokens that the queues have given before the window."""
        got = self.seen.get(window)
        if got is None:
            k = self.border(window)
            at, before, live = self.phases[max(0, bisect_right(self.phases, k, key=lambda p: p[0]) - 1)] if self.phases else (0, [0] * len(self.totals), self.totals)
            got = [g + s for g, s in zip(before, self._shares(k - at, live), strict=True)]
            if len(self.seen) > self.keep:
                self.seen.clear()
            self.seen[window] = got
        return got

    def deficits(self, window: int) -> list[float]:
        """What each queue is owed when the window begins: its proportion of all tokens of the phase so far, less what it gave."""
        k = self.border(window)
        if not self.phases:
            return [0.0] * len(self.totals)
        at, before, live = self.phases[bisect_right(self.phases, k, key=lambda p: p[0]) - 1]
        return [(k - at) * w / sum(live) - (g - b) for w, g, b in zip(live, self.given(window), before, strict=True)]

    def window_of(self, queue: int, place: int) -> int:
        """The window that holds the queue's token at ``place``."""
        low, high = 0, self.windows - 1
        guess = min(high, place * self.windows // max(1, self.totals[queue]))
        step = 1
        while True:  # gallop out from the proportional guess
            a, b = max(low, guess - step), min(high, guess + step)
            if self.given(a)[queue] <= place and (b == high or self.given(b)[queue] > place):
                return bisect_right(range(a, b + 1), place, key=lambda w: self.given(w)[queue]) + a - 1
            step *= 4


def tokenize(df: DataFrame, path: str, end_id: int, doc_id: str, text: str, source: str) -> DataFrame:
    """Ids of each document with its end id, and where it starts in its task's part of its source's queue."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))

    def run(batches):
        enc = encoder(path)
        end = end_id.to_bytes(enc.width, "little")
        split, given = TaskContext.get().partitionId(), {}
        for b in batches:
            ids = [x + end for x in enc.encode_batch(column(b, "text").to_pylist())]
            starts, sources = [], column(b, "source").to_pylist()
            for s, x in zip(sources, ids, strict=True):
                starts.append(given.get(s, 0))
                given[s] = starts[-1] + len(x) // enc.width
            cols = [column(b, "doc_id"), column(b, "source"), pa.array([split] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "split", "local", "n", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, source string, split long, local long, n long, ids binary")


def _mixture(ids: DataFrame, length: int, targets: dict | None) -> tuple[list, Mixture, DataFrame]:
    """Queues in order, their mixture, and a table of where each task's part of a source starts in its queue."""
    parts = ids.groupBy("split", "source").agg(F.sum("n").alias("n"))
    several = parts.select("source").distinct().count() > QUEUES
    own = F.lit(True) if not several else F.coalesce(F.col("source").isin([t for t in targets or {} if t is not None]), F.col("source").isNull())
    queue = F.when(own, F.struct(F.lit(0).alias("bucket"), F.col("source").alias("name"))).otherwise(F.struct((F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("int") + 1).alias("bucket"), F.lit(None).cast("string").alias("name")))
    before = Window.partitionBy("queue").orderBy("split", "source").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-offsets")
    totals = {(r["queue"]["bucket"], r["queue"]["name"]): r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    order = sorted(totals, key=lambda q: (totals[q], q[0], q[1] is not None, q[1] or ""))
    weights = None
    if targets is not None:
        if any(w < 0 for w in targets.values()):
            raise ValueError("target proportions must not be negative")
        weights = [round(targets.get(name, 0) * 2**30 / max(sum(targets.values()), 1e-300)) if not bucket else 0 for bucket, name in order]
    return order, Mixture([totals[q] for q in order], length, weights), parts


def mixture_report(df: DataFrame, path: str, targets: dict | None = None, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``sequence_id, source, tokens, deficit``: what each queue gives to each window, and what it is owed when the window begins."""
    order, mix, _ = _mixture(materialize(tokenize(df, path, end_id, doc_id, text, source), "packing-ids"), length, targets)
    names = [name if not bucket else f"#{bucket}" for bucket, name in order]

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for w in column(b, "id").to_pylist():
                for name, a, z, owed in zip(names, mix.given(w), mix.given(w + 1), mix.deficits(w), strict=True):
                    for c, v in zip(out, (w, name, z - a, owed), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["sequence_id", "source", "tokens", "deficit"])

    return df.sparkSession.range(mix.windows).mapInArrow(run, "sequence_id long, source string, tokens long, deficit double")


def pack(df: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = True, targets: dict | None = None) -> DataFrame:
    """One row per piece: its document, ``start`` and ``length`` there, its sequence and offset, checksum, and the ids on request.

    ``targets``: token proportions by source. The ids are written once; the queues' totals (a row per queue) come to the driver,
    offsets of the tasks' parts are a running sum over a summary table with a row per task and source.
    """
    small_batches(df.sparkSession)
    ids = materialize(tokenize(df, path, end_id, doc_id, text, source), "packing-ids")
    order, mix, parts = _mixture(ids, length, targets)
    place = {q: k for k, q in enumerate(order)}
    mix_args = mix.totals, length, mix.weights
    offsets = parts.select(F.col("split").alias("of_split"), F.col("source").alias("of_source"), "base", "queue")
    offsets = F.broadcast(offsets) if parts.count() <= BROADCAST_ROWS else offsets
    rows = ids.join(offsets, (F.col("split") == F.col("of_split")) & F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "queue.bucket", "queue.name", "n", "ids", (F.col("base") + F.col("local")).alias("at"))
    width = encoder(path).width

    def run(batches):
        mix = Mixture(*mix_args)
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, bucket, name, n, raw, at in zip(*(values_of(b, c) for c in ("doc_id", "bucket", "name", "n", "ids", "at")), strict=True):
                q, data, start = place[bucket, name], wide(raw, width), 0
                window = mix.window_of(q, at)
                while start < n:
                    first, last = mix.given(window), mix.given(window + 1)
                    take = min(n - start, last[q] - at - start)
                    if take > 0:
                        piece = data[start : start + take].tobytes()
                        offset = sum(last[:q]) - sum(first[:q]) + at + start - first[q]
                        for c, v in zip(out, (doc, start, take, zlib.crc32(piece), n, window, offset, piece), strict=True):
                            c.append(v)
                        start += take
                    window += 1
            cols = [pa.array(out[0], b.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in out[1:7])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array(out[7], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def query(spark, sf_dir):
    return pack(documents(spark, sf_dir), token_path("word_bpe_49k.json"), with_ids=False)


def stage(spark, docs, sf_dir):
    """Pipeline stage: the packed pieces of the documents that are left."""
    return pack(docs, token_path("word_bpe_49k.json"), with_ids=True)
