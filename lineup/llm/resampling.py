"""Operator 13: importance resampling of documents towards a target text, on hashed word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, lower-cased in A-Z. Features are all runs of 1 to ``orders`` words, joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

The CRC of a span is an XOR: ``table[d][b]`` is what byte ``b`` adds at distance ``d`` from the span's end, and ``length_constant(n)`` is the CRC of ``n`` zero
bytes (what the start value and the final inversion add). All spans of a piece of text are hashed at once: one table look-up per
byte, ``bitwise_xor.reduceat`` over the spans, one length constant each. Spans of more than ``DEPTH`` bytes are cut into blocks of ``DEPTH`` from their end, and
the blocks are folded from the front: the state is moved on by ``DEPTH`` zero bytes (four look-ups) and XORed with the next block.

Two scans: the first sums the buckets of all documents and of the target (``buckets`` numbers a task, summed by bucket), the second scores. A bucket's
gain is ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))``, a document's weight the floored mean of its features' gains, its score the weight
plus a Gumbel draw from the hash of ``seed:doc_id``, so the highest scores are a sample without replacement in proportion to ``exp(weight / 1000)``.
Ranks need no window over all rows: rows are counted by score (whole numbers in a range of about 100,000 whatever the corpus: both logarithms are bounded), and
rows of one score are ordered on their own.

Defined results: null and empty texts have no features and weight 0 and are not drawn; rows with a null ``doc_id`` draw from ``seed:`` and come last
among ties; repeated rows take ranks one after the other; without target text all gains come from ``t = T = 0``; an empty table gives no rows; extra columns are not
read. Texts are read in pieces of whole words, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineup.llm.common import documents, lower_ascii, materialize, small_batches, utf8, values_of

BUCKETS, ORDERS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
#: Distances from the end of a span that have a table; longer spans are folded in blocks of so many bytes.
DEPTH = 64
_POLYNOMIAL = 0xEDB88320
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: About 64 KB that end with a whole word.
_PIECE = re.compile(rb"(?s).{1,65536}[0-9a-z\x80-\xFF]*")


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(_POLYNOMIAL), state >> 1)
    return state


def _position_tables() -> tuple[np.ndarray, np.ndarray]:
    """Contribution of each byte at each distance from the end, and of each byte of a state that is moved on by ``DEPTH`` zero bytes."""
    first = _byte_table()

    def moved(state: np.ndarray) -> np.ndarray:
        return first[state & 255] ^ (state >> 8)

    table = [first]
    while len(table) < DEPTH:
        table.append(moved(table[-1]))
    on = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(DEPTH):
        on = moved(on)
    return np.array(table), on


_TABLE, _ON = _position_tables()
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], dtype=np.uint32)


def length_constants(length: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    out = _ZEROS[np.minimum(length, DEPTH)]
    for n in np.unique(length[length > DEPTH]).tolist():
        out[length == n] = zlib.crc32(bytes(n))
    return out


def _xor_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XOR of the position tables over spans of 1 to ``DEPTH`` bytes."""
    at = np.cumsum(length) - length
    flat = np.arange(int(length.sum())) + np.repeat(start - at, length)
    distance = np.repeat(start + length - 1, length) - flat
    return np.bitwise_xor.reduceat(_TABLE[distance, data[flat]], at)


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span ``data[start:end]``, none of them empty."""
    length = end - start
    out = np.zeros(len(start), dtype=np.uint32)
    short = length <= DEPTH
    if short.any():
        out[short] = _xor_spans(data, start[short], length[short])
    long = np.flatnonzero(~short)
    if len(long):
        blocks = -(-length[long] // DEPTH)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        # the first block takes what is over, so that all others are whole
        till = np.repeat(end[long], blocks) - DEPTH * (np.repeat(blocks, blocks) - 1 - nth)
        begin = np.maximum(till - DEPTH, np.repeat(start[long], blocks))
        part = _xor_spans(data, begin, till - begin)
        state = part[first]
        for k in range(1, int(blocks.max())):
            more = np.flatnonzero(blocks > k)
            s = state[more]
            state[more] = _ON[0][s & 255] ^ _ON[1][s >> 8 & 255] ^ _ON[2][s >> 16 & 255] ^ _ON[3][s >> 24] ^ part[first[more] + k]
        out[long] = state
    return out ^ length_constants(length)


def _normal(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a lower-cased piece with one space between them, and where each starts and ends."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = _WORD[raw]
    behind = np.zeros_like(word)
    behind[1:] = word[:-1] & ~word[1:]
    keep = word | behind
    text, word = np.where(word, raw, 32).astype(np.uint8)[keep], word[keep]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return text, edge[::2], edge[1::2]


def feature_buckets(text: str | None, orders: int = ORDERS, buckets: int = BUCKETS):
    """Words and an array of buckets for each piece of the text; every run of 1 to ``orders`` words gives one."""
    data, last = lower_ascii(utf8(text)), b""
    for m in _PIECE.finditer(data):
        carried = last.count(b" ")
        normal, start, end = _normal(last + m.group())
        found = []
        for n in range(1, orders + 1):  # the runs that end with a word of this piece
            ends = np.arange(max(carried, n - 1), len(start))
            if len(ends):
                found.append(span_crcs(normal, start[ends - n + 1], end[ends]) % np.uint32(buckets))
        yield len(start) - carried, np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int64)
        if orders > 1 and len(start):
            last = normal[start[max(0, len(start) - orders + 1)] : end[-1]].tobytes() + b" "


def bucket_counts(df: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: occurrences of features over all rows."""
    small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for value in values_of(b, text):
                for _, found in feature_buckets(value, orders, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return df.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A gain for each bucket, from the counts of the corpus and of the target: ``buckets`` numbers."""

    def counts(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in df.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(source), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((a + 1) * all_s / ((b + 1) * all_t))) for a, b in zip(t, s)], dtype=np.int64)


def gumbel(doc_id: int | None, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, orders: int = ORDERS, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row."""
    small_batches(df.sparkSession)
    held, buckets = df.sparkSession.sparkContext.broadcast(gain), len(gain)  # ``buckets`` numbers

    def run(batches):
        of = held.value
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for doc_id, value in zip(ids, values_of(b, "text")):
                words = n = total = 0
                for w, found in feature_buckets(value, orders, buckets):
                    words, n, total = words + w, n + len(found), total + int(of[found].sum())
                weight = total // n if n else 0
                rows.append((words, n, weight, weight + gumbel(doc_id, seed)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(df: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``; drawn rows have a rank from 1, all others none."""
    spark = df.sparkSession
    gain = gains(bucket_counts(df, "text", orders, buckets), bucket_counts(target, "text", orders, buckets), buckets)
    rows = materialize(scored(df, gain, orders, seed), "resampling-scores")
    eligible = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, before, base = percent * sum(n for _, n in by_score) // 100, 0, []
    for score, n in by_score:
        if before >= draw:
            break
        base.append((score, before))
        before += n
    cut = base[-1][0] if base else None
    none = rows.withColumn("rank", F.lit(None).cast("bigint"))
    if cut is None:
        return none
    high = eligible & (F.col("score") >= cut)
    ties = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    top = rows.where(high).join(F.broadcast(spark.createDataFrame(base, "score long, before long")), "score")
    place = F.col("before") + F.row_number().over(ties)
    top = top.withColumn("rank", F.when(place <= draw, place).cast("bigint"))
    return top.select(none.columns).unionByName(none.where(~high))


def drawn(df: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents of ``df`` that are drawn, whole rows."""
    ids = resample(df, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return df.join(ids, df["doc_id"] == ids["_drawn"], "left_semi")


def query(spark, sf_dir):
    rows = resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 a distinct word at a time: the table of 256 bytes, then a reduction over the word's bytes.
SQL = r"""
WITH polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
source AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
found AS (SELECT doc_id, unnest(words) AS word FROM source),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM found UNION ALL SELECT word FROM target)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda j: ('0x' || substr(hex(word), (2 * j + 1)::INT, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, polynomial),
s AS (SELECT bucket, count(*) AS s FROM found JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM found JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM source LEFT JOIN weights USING (doc_id)),
summed AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scores),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS draw FROM summed WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM summed LEFT JOIN ranks USING (doc_id)
"""
