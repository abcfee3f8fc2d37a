"""Operator 10: substring deduplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document; words are removed where a window's word sequence also starts in a document
with a smaller doc_id. Windows are routed by their anchor, the smallest hash among their eight-word runs: equal windows have equal
anchors, and neighbouring windows of one anchor form a segment of at most 43 windows. Anchors of one document only are dropped
first (partial aggregates, nothing but hashes is shuffled). Of equal segments only the smallest document's is a
candidate source; the others are removed whole. Segments of anchors with several distinct segments go to shards. A shard's segments
are concatenated into one integer text with a suffix order, its Burrows-Wheeler transform is kept in a wavelet matrix of
packed bits with rank directories, and each segment is streamed against the index: backward search from a window's last word keeps the
interval of equal places and the smallest document among them, which gives the matching statistics that decide whether a
window of threshold length starts in a smaller document.

Of a segment's places only the first in its smallest document is searched, the others take over what is found, so a periodic text does not fill a shard.
Anchors with more than ``SHARD_SEGMENTS`` distinct segments are dealt over several shards by a hash; the windows of those anchors are also
compared between shards by their anchor and hash, so no shard and no task grows with a frequent passage, and no repeat is lost.

Defined results: null, empty and short texts (under ``WINDOW`` words) lose nothing; doc_id is the key: rows that share one must hold the
same text, and a window never counts as repeated by rows of its own doc_id; a null doc_id keeps its text; empty tables give no rows;
other columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import column, discard, documents, free_name, gram_hashes, materialize, mix64, pieces, signed, small_batches, utf8, values_of, word_hashes

WINDOW, GRAM = 50, 8
SPREAD = WINDOW - GRAM + 1
SHARD_SEGMENTS = 512
#: Ids (8 bytes each) that are broadcast at most, so that only the texts that are asked for are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words of one FM-index.
INDEX_WORDS = 200_000
_BASE = 0x9E6C63D0876A9A47


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of ``k`` values, by doubling."""
    out, span = x, 1
    while 2 * span <= k:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(out) - (k - span)], out[k - span :]) if span < k else out


def _powers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(_BASE), dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class Ranges:
    """Hashes of word ranges of one document."""

    def __init__(self, words: np.ndarray):
        self.up = _powers(len(words) + 1)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:-1], dtype=np.uint64)])
        self.last = len(words)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # shifted to the document's last power, so equal words give equal hashes wherever they stand
        total = (self.sum[end] - self.sum[start]) * _inverse(start)
        return mix64(total + (end - start).astype(np.uint64))


def _inverse_powers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_INVERSE: list[np.ndarray] = []


def _inverse(start: np.ndarray) -> np.ndarray:
    """Inverse powers of the base modulo 2^64; a table of 8 MB is kept, longer ones serve one document."""
    need = int(start.max(initial=0)) + 1
    if need > 1 << 20:
        return _inverse_powers(need)[start]
    if not _INVERSE:
        _INVERSE.append(_inverse_powers(1 << 20))
    return _INVERSE[0][start]


def segments(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of each segment of a document."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchor = _sliding_min(gram_hashes(words, GRAM), SPREAD)
    n = len(anchor)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    # runs longer than SPREAD windows (periodic text) are cut
    length = np.diff(np.r_[first, n])
    parts = -(-length // SPREAD)
    start = np.repeat(first, parts) + SPREAD * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.minimum(np.repeat(first + length, parts) - start, SPREAD)
    return anchor[start], Ranges(words).of(start, start + count - 1 + WINDOW), start, count


def _scan(batches):
    for b in batches:
        out = [[] for _ in range(5)]
        for doc, text in zip(values_of(b, "doc_id"), values_of(b, "text"), strict=True):
            anchor, seg, start, count = segments(word_hashes(utf8(text)))
            if len(anchor):
                for c, v in zip(out, (signed(anchor), signed(seg), np.full(len(anchor), doc), start, count), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, names=["anchor", "seg", "doc_id", "start", "windows"])


SEGMENT = "anchor long, seg long, doc_id long, start int, windows int"


class Bits:
    """Packed bits with a directory of counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Backward search over the wavelet matrix of a text's Burrows-Wheeler transform, for patterns up to ``depth`` symbols.

    ``text`` has symbols from 0 (separator) to ``sigma - 1``; ``owner`` is the document of each position.
    """

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray, depth: int = 64):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:  # suffixes ordered by their first ``depth`` symbols
            after = np.zeros(n, dtype=np.int64)
            after[: n - span] = rank[span:] + 1
            _, rank = np.unique(rank * np.int64(n + sigma + 2) + after, return_inverse=True)
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        bwt = text[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros, left = [], [], bwt
        base = np.zeros(sigma, dtype=np.int64)
        symbols = np.arange(sigma)
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> level & 1).astype(np.uint8)
            row = Bits(bit)
            zeros = int(n - bit.sum())
            ones = row.ones(base)
            base = np.where(symbols >> level & 1, zeros + ones, base - ones)
            self.bits.append(row)
            self.zeros.append(zeros)
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        self.base = base
        docs = owner[self.order]
        self.least = [docs]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` followed by the pattern of each interval."""
        m = len(symbol)
        both = np.concatenate([low, high])
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].ones(both)
            bit = (symbol >> level & 1).astype(bool)
            both = np.where(np.concatenate([bit, bit]), self.zeros[k] + ones, both - ones)
        shift = self.first[symbol] - self.base[symbol]
        return both[:m] + shift, both[m:] + shift

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document among the places of non-empty intervals."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for v in np.unique(level):
            at = level == v
            row = self.least[v]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(v))])
        return out


def matching(index: FMIndex, text: np.ndarray, begin: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each segment that starts in a smaller document, or -1.

    A segment's windows overlap, so the words between its first and last repeated windows are covered by the two.
    A failed search that stopped before word i tells that no window holding the words from i to its end is repeated.
    """
    m = len(begin)
    first, last = np.full(m, -1), np.full(m, -1)
    window, rising = np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    done = np.zeros(m, dtype=np.int64)  # words of the window that are matched, from its end
    low, high = np.zeros(m, dtype=np.int64), np.full(m, len(text))
    live = np.arange(m)
    while len(live):
        symbol = text[begin[live] + window[live] + WINDOW - 1 - done[live]]
        lo, hi = index.step(symbol, low[live], high[live])
        fine = hi > lo
        fine[fine] = index.smallest(lo[fine], hi[fine]) < doc[live[fine]]
        good = live[fine]
        low[good], high[good] = lo[fine], hi[fine]
        done[good] += 1
        won = good[done[good] == WINDOW]
        lost = live[~fine]
        up, down = won[rising[won]], won[~rising[won]]
        first[up], last[up] = window[up], window[up]
        rising[up] = False
        window[up] = windows[up] - 1
        last[down] = window[down]
        rose = lost[rising[lost]]
        window[rose] += WINDOW - done[rose]
        fell = lost[~rising[lost]]
        window[fell] -= 1
        turned = np.concatenate([won, lost])
        done[turned], low[turned], high[turned] = 0, 0, len(text)
        over = np.zeros(m, dtype=bool)
        over[down] = True
        over[rose] = window[rose] >= windows[rose]
        ends = np.concatenate([up, fell])
        over[ends] |= window[ends] <= first[ends]
        live = live[~over[live]]
    return first, last


def _search(batches):
    """Covered word ranges of segments (kind 0) and, for anchors on several shards, their windows (kind 1); ``place`` is the segment's start."""
    rows, size = [], 0

    def flush(rows):
        words, text, begin, owner, at = {}, [np.zeros(1, np.int64)], [], [np.full(1, np.iinfo(np.int64).max)], 1
        hashed = []
        for r in rows:
            w = word_hashes(r["words"])
            hashed.append(w)
            text.append(np.fromiter((words.setdefault(x, len(words) + 1) for x in w.tolist()), np.int64, len(w)))
            text.append(np.zeros(1, np.int64))
            begin.append(at)
            owner.append(np.full(len(w) + 1, r["doc_id"]))
            at += len(w) + 1
        text, owner = np.concatenate(text), np.concatenate(owner)
        index = FMIndex(text, len(words) + 1, owner)
        docs = np.array([r["doc_id"] for r in rows])
        first, last = matching(index, text, np.array(begin), np.array([r["windows"] for r in rows]), docs)
        # of anchors on several shards, a window leaves its shard once: for the smallest document that holds it
        inner = [(k, w) for k, r in enumerate(rows) if r["shards"] > 1 for w in range(int(first[k]) + 1, int(last[k]))]
        found = set()
        if inner:
            at = np.array(inner)
            hit, _ = matching(index, text, np.array(begin)[at[:, 0]] + at[:, 1], np.ones(len(at), dtype=np.int64), docs[at[:, 0]])
            found = {pair for pair, h in zip(inner, hit.tolist(), strict=True) if h >= 0}
        out = [[] for _ in range(7)]
        for place, (r, w, a, z) in enumerate(zip(rows, hashed, first.tolist(), last.tolist(), strict=True)):
            if a >= 0:
                for c, v in zip(out, (0, r["doc_id"], r["start"] + a, r["start"] + z + WINDOW, r["anchor"], 0, r["start"]), strict=True):
                    c.append(v)
            if r["shards"] > 1:
                n = np.arange(r["windows"])
                for k, h in zip(n.tolist(), signed(Ranges(w).of(n, n + WINDOW)).tolist(), strict=True):
                    if k not in (a, z) and (place, k) not in found:
                        for c, v in zip(out, (1, r["doc_id"], r["start"] + k, r["start"] + k + WINDOW, r["anchor"], h, r["start"]), strict=True):
                            c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["kind", "doc_id", "start", "end", "anchor", "hash", "place"])

    last = None
    for b in batches:
        for r in b.to_pylist():
            key = r["anchor"], r["shard"]
            if key != last and size > INDEX_WORDS:
                yield flush(rows)
                rows, size = [], 0
            last = key
            rows.append(r)
            size += r["windows"] + WINDOW
    if rows:
        yield flush(rows)


def _slices(data: bytes, wanted: list):
    """The words of each wanted segment (sorted by start), from a text that is read in pieces."""
    held, base, k = [], 0, 0
    for piece in pieces(data):
        held += piece.split()
        while k < len(wanted) and wanted[k]["start"] + wanted[k]["windows"] - 1 + WINDOW <= base + len(held):
            at = wanted[k]["start"] - base
            yield wanted[k], b" ".join(held[at : at + wanted[k]["windows"] - 1 + WINDOW])
            k += 1
        if k == len(wanted):
            return
        drop = min(len(held), max(0, wanted[k]["start"] - base))
        held, base = held[drop:], base + drop


def _cut(batches):
    """The words of the requested segments of each document."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for b in batches:
        out = [[] for _ in range(7)]
        for doc, text, wanted in zip(values_of(b, "doc_id"), values_of(b, "text"), values_of(b, "wanted"), strict=True):
            for r, part in _slices(utf8(text), sorted(wanted, key=lambda r: r["start"])):
                for c, v in zip(out, (r["anchor"], r["shard"], r["shards"], doc, r["start"], r["windows"], part), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "shard", "shards", "doc_id", "start", "windows", "words"])


def _picked(docs: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame | None:
    """The documents of some ids without a shuffle of the texts, where the ids are few enough to be broadcast; else all documents, or None for the others."""
    if ids.count() > BROADCAST_ROWS:
        return docs if how == "left_semi" else None
    one = ids.toDF("picked_id_")
    return docs.join(F.broadcast(one), docs[key].cast("long") == one["picked_id_"], how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: word ranges (start, end) to remove, for documents (``doc_id`` long, ``text``) that have any."""
    small_batches(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    scan = materialize(docs.mapInArrow(_scan, SEGMENT), "repeats-scan")
    shared = scan.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    shared = materialize(shared, "repeats-anchors")
    rows = materialize(scan.join(shared, "anchor"), "repeats-segments")
    discard(scan, shared)
    # of a segment's places only the first of its smallest document is searched
    sources = rows.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("anchor", "seg", F.col("at.doc_id").alias("source"), F.col("at.start").alias("place"), F.lit(1).alias("one"))
    sources = materialize(sources, "repeats-sources")
    several = materialize(sources.groupBy("anchor").agg(F.sum("one").alias("n")).where("n > 1"), "repeats-several")
    placed = rows.join(sources.drop("one"), ["anchor", "seg"])
    end = F.col("start") + F.col("windows") - 1 + WINDOW
    copies = placed.where("doc_id > source").select("doc_id", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))
    again = placed.where("doc_id = source and start <> place").select("doc_id", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("moved"))
    again = materialize(again, "repeats-again")
    shards = F.ceil(F.col("n") / SHARD_SEGMENTS).cast("int")
    wanted = placed.where("doc_id = source and start = place").join(several, "anchor").withColumn("shards", shards)
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("source", "start"), F.col("shards")).cast("int"))
    wanted = wanted.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "shard", "shards", "start", "windows")).alias("wanted"))
    wanted = materialize(wanted, "repeats-wanted")
    cut = _picked(docs, "doc_id", wanted.select("doc_id")).join(wanted, "doc_id").mapInArrow(_cut, "anchor long, shard int, shards int, doc_id long, start int, windows int, words binary")
    found = cut.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").mapInArrow(_search, "kind long, doc_id long, start long, end long, anchor long, hash long, place long")
    found = materialize(found, "repeats-found")
    between = found.where("kind = 1").select("anchor", "hash", "doc_id", "start", "end", "place")
    least = materialize(between.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor", "hash", "least"), "repeats-between")
    more = between.join(least, ["anchor", "hash"]).where("doc_id > least").select("doc_id", "start", "end", "place")
    searched = found.where("kind = 0").select("doc_id", "start", "end", "place").unionByName(more)
    shift = F.col("moved") - F.col("place")
    moved = searched.join(again, ["doc_id", "place"]).select("doc_id", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    spans = copies.unionByName(searched.drop("place")).unionByName(moved)
    spans = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats-spans")
    discard(rows, sources, several, again, wanted, found, least)
    return spans


def kept_words(data: bytes, spans: list | None):
    """For each piece of a text: its number of words, and those outside the spans."""
    merged: list[list[int]] = []
    for a, z in sorted((s["start"], s["end"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    base, k = 0, 0
    for piece in pieces(data):
        words = piece.split()
        end, at, out = base + len(words), base, []
        while k < len(merged) and merged[k][0] < end:
            a, z = merged[k]
            out += words[at - base : max(at, a) - base]
            at = max(at, min(z, end))
            if z > end:
                break
            k += 1
        out += words[at - base :]
        base = end
        yield len(words), out


def _with_spans(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    spans = repeated_spans(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    name, key = free_name(df, "spans"), free_name(df, "span_doc")
    spans = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    rest = _picked(df, doc_id, spans.select(key), "left_anti")
    some = df if rest is None else _picked(df, doc_id, spans.select(key))
    some = some.join(spans, some[doc_id].cast("long") == spans[key], "left").drop(key)
    return (some if rest is None else some.unionByName(rest.withColumn(name, F.lit(None).cast(some.schema[name].dataType)))), name


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated words taken out of ``text``; texts that lose nothing stay as they are, others are joined by one space."""
    joined, name = _with_spans(df, doc_id, text)
    names = df.columns

    def run(batches):
        for b in batches:
            kept = []
            for t, s in zip(values_of(b, text), values_of(b, name), strict=True):
                kept.append(b" ".join(b" ".join(w) for _, w in kept_words(utf8(t), s) if w).decode("utf-8", "surrogatepass") if s else t)
            cols = [pa.array(kept, b.schema.field(c).type) if c == text else column(b, c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, df.schema)


def digests(df: DataFrame) -> DataFrame:
    joined, name = _with_spans(df.select("doc_id", "text"), "doc_id", "text")

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for t, s in zip(values_of(b, "text"), values_of(b, name), strict=True):
                digest, total, left = hashlib.sha256(), 0, 0
                for m, words in kept_words(utf8(t), s):
                    if words:
                        digest.update((b" " if left else b"") + b" ".join(words))
                    total, left = total + m, left + len(words)
                n.append(total), gone.append(total - left), sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir):
    return digests(documents(spark, sf_dir))


def stage(spark, docs, sf_dir):
    """Pipeline stage: the documents without the words that repeat an earlier document; character counts follow the text."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
