"""Operator 6: token ids in a content-addressed binary store.

Format, under one folder: ``chunks`` (key, ids: each distinct chunk of ids once, addressed by the BLAKE2 digest of its bytes),
``recipes`` (documents in ascending doc_id order: place, number of ids, ids before the document, the keys of its chunks in order)
``manifest`` (a row per block of 4,096 recipes: documents, ids, first place, Merkle root of its documents' keys) and ``roots`` (the levels above: a root
per recipe part, then per 4,096 roots, up to one root of the whole store). A rolling hash
over the ids cuts a document into chunks, so equal passages give equal chunks. Ids are little-endian unsigned
16-bit integers where the vocabulary allows, else 32-bit.

Reading verifies: a chunk whose bytes do not give its key, or a recipe block or level whose Merkle root is not the stored one, raises an error.

Defined results: null and empty texts hold the end id only; rows that share a doc_id are stored as separate documents, in the order of their
ids; null doc_ids come first; empty tables give empty stores; extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineup.llm.common import column, documents, materialize, mix64, new_path
from lineup.llm.tokens import encoder, token_path, wide

END_ID = 0
SPAN, LEAST, MOST = 8, 64, 4096
MASK = np.uint64(511)
#: A table with a row per recipe part (16 bytes) is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 20_000


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(n - SPAN + 1, dtype=np.uint64)
    for j in range(SPAN):
        total += mixed[j : n - SPAN + 1 + j] << np.uint64(j)
    out, last = [], 0
    for end in [*(np.flatnonzero((total >> np.uint64(24)) & MASK == 0) + SPAN).tolist(), n]:
        if end - last < LEAST and end < n:
            continue
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def key_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [key_of(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


# crc32 of joined byte strings from the parts' values: the first is advanced over the second's length in zero bytes
def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo the CRC-32 polynomial, elementwise."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def _shifts(most: int) -> np.ndarray:
    """``x^(32 k)`` for k ids of four bytes."""
    out = np.full(most + 1, np.uint64(1 << 31), dtype=np.uint64)
    word = np.full(1, np.uint64(1 << 31))
    one = np.full(1, np.uint64(1 << 30))
    for _ in range(32):
        word = _product(word, one)
    have = 1
    power = word  # x^(32 * have)
    while have <= most:
        n = min(have, most + 1 - have)
        out[have : have + n] = _product(out[:n], np.repeat(power, n))
        power = _product(power, power)
        have *= 2
    return out


_SHIFT: list[np.ndarray] = []


def joined_crc(crcs: list[list[int]], counts: list[list[int]]) -> list[int]:
    """CRC-32 of each document from the values and id counts of its chunks in order."""
    if not _SHIFT:
        _SHIFT.append(_shifts(MOST))
    size = np.array([len(c) for c in crcs], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    total = np.zeros(len(crcs), dtype=np.uint64)
    for k in range(int(size.max(initial=0))):
        live = order[: np.searchsorted(-size[order], -k, side="left")]
        crc = np.array([crcs[i][k] for i in live], dtype=np.uint64)
        n = np.array([counts[i][k] for i in live], dtype=np.int64)
        total[live] = crc if k == 0 else _product(total[live], _SHIFT[0][n]) ^ crc
    return total.tolist()


def write_store(df: DataFrame, folder: str, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append the end id, and write the store."""
    spark = df.sparkSession
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def encode(batches):
        enc, seen = encoder(path), set()
        end = end_id.to_bytes(enc.width, "little")
        w = enc.width
        for b in batches:
            sizes, keys, parts = [], [], []
            for raw in enc.encode_batch(column(b, "text").to_pylist()):
                raw += end
                ends = cuts(np.frombuffer(raw, enc.dtype))
                pieces = [raw[a * w : z * w] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                own = [key_of(p) for p in pieces]
                sizes.append(ends[-1])
                keys.append(own)
                new = []
                for k, p in zip(own, pieces, strict=True):  # a chunk leaves its task once
                    new.append(None if k in seen else p)
                    seen.add(k)
                parts.append(new)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "n", "keys", "parts"]
            )

    staged = materialize(src.mapInArrow(encode, "doc_id long, n long, keys array<binary>, parts array<binary>"), "store-staged")
    chunks = staged.select(F.explode(F.arrays_zip("keys", "parts")).alias("c")).where("c.parts is not null").select(F.col("c.keys").alias("key"), F.col("c.parts").alias("ids"))
    chunks.groupBy("key").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{folder}/chunks")

    def place(batches):
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = column(b, "n").to_pylist()
            rows, starts = [], []
            for n in sizes:
                rows.append(row)
                starts.append(before)
                row += 1
                before += n
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), *b.columns], names=["part", "row", "local", *b.schema.names])

    sorted_ = staged.select("doc_id", "n", "keys").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "keys")
    placed = materialize(sorted_.mapInArrow(place, "part long, row long, local long, doc_id long, n long, keys array<binary>"), "store-placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range partition: the running sum over parts is small whatever the input
    parts = materialize(placed.groupBy("part").agg(F.sum("n").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select(F.col("part").alias("of_part"), "base"), "store-bases")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    recipes = placed.join(parts, F.col("part") == F.col("of_part")).select("part", "row", "doc_id", "n", (F.col("base") + F.col("local")).alias("start"), "keys")
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _roots(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    _levels(spark.read.parquet(f"{folder}/manifest")).write.parquet(f"{folder}/roots")


def _roots(recipes: DataFrame) -> DataFrame:
    """A manifest row per part: leaves are digests of blocks of 4096 recipes, so that no task gathers an unbounded list."""
    leaf = F.sha2(F.concat(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n"), F.col("start")).cast("binary"), F.lit(b";"), F.array_join(F.transform("keys", F.hex), "").cast("binary")), 256)
    blocks = recipes.select("part", F.floor(F.col("row") / 4096).alias("block"), "row", "n", "start", leaf.alias("leaf"))
    blocks = blocks.groupBy("part", "block").agg(F.array_sort(F.collect_list(F.struct("row", "leaf"))).alias("leaves"), F.count("*").alias("documents"), F.sum("n").alias("ids"), F.min("start").alias("start"))

    def run(batches):
        for b in batches:
            roots = [merkle([x["leaf"].encode() for x in leaves]) for leaves in column(b, "leaves").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("part", "block", "documents", "ids", "start")), pa.array(roots, pa.binary())], names=["part", "block", "documents", "ids", "start", "root"])

    return blocks.mapInArrow(run, "part long, block long, documents long, ids long, start long, root binary")


#: Roots that one root of the next level covers.
FAN = 4096


def _merged(batches):
    for b in batches:
        roots = [merkle([bytes(x["root"]) for x in below]) for below in column(b, "below").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(b, "level"), column(b, "idx"), pa.array(roots, pa.binary())], names=["level", "idx", "root"])


def _levels(blocks: DataFrame) -> DataFrame:
    """``level, idx, root`` above the blocks: level 1 has a root per part, the last level one root; a group is a part's blocks or ``FAN`` roots."""
    below = F.array_sort(F.collect_list(F.struct("at", "root"))).alias("below")
    rows, level, out = blocks.select(F.col("part").alias("idx"), F.col("block").alias("at"), "root"), 1, None
    while True:
        rows = rows.groupBy("idx").agg(below).select(F.lit(level).cast("long").alias("level"), "idx", "below").mapInArrow(_merged, "level long, idx long, root binary")
        rows = materialize(rows, "store-roots")
        out = rows if out is None else out.unionByName(rows)
        if rows.limit(2).count() < 2:
            return out
        rows, level = rows.select(F.floor(F.col("idx") / FAN).cast("long").alias("idx"), F.col("idx").alias("at"), "root"), level + 1


def store_root(spark: SparkSession, folder: str) -> bytes | None:
    """The root of the whole store; None for an empty one."""
    top = spark.read.parquet(f"{folder}/roots").agg(F.max_by("root", "level").alias("root")).first()
    return None if top["root"] is None else bytes(top["root"])


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Raise if a recipe block, or a level above the blocks, does not have the stored Merkle root."""
    wanted = spark.read.parquet(f"{folder}/manifest").select("part", "block", F.col("root").alias("wanted"))
    found = _roots(spark.read.parquet(f"{folder}/recipes")).select("part", "block", "root")
    if not wanted.join(found, ["part", "block"], "full").where(~F.col("wanted").eqNullSafe(F.col("root"))).isEmpty():
        raise ValueError("the recipes do not match the manifest")
    above, again = spark.read.parquet(f"{folder}/roots").withColumnRenamed("root", "wanted"), _levels(spark.read.parquet(f"{folder}/manifest"))
    if not above.join(again, ["level", "idx"], "full").where(~F.col("wanted").eqNullSafe(F.col("root"))).isEmpty():
        raise ValueError("the manifest does not match the store's root")


def _verified(width: int):
    def run(batches):
        for b in batches:
            crc, n = [], []
            for key, raw in zip(column(b, "key").to_pylist(), column(b, "ids").to_pylist(), strict=True):
                if key_of(raw) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its key")
                ids = wide(raw, width)
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([column(b, "key"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["key", "crc", "size"])

    return run


def read_digests(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: chunks are verified and summed where they lie, only digests are shuffled."""
    chunks = spark.read.parquet(f"{folder}/chunks").mapInArrow(_verified(width), "key binary, crc long, size long")
    uses = spark.read.parquet(f"{folder}/recipes").select("part", "row", "doc_id", "n", "start", F.posexplode("keys").alias("at", "key"))
    docs = uses.join(chunks, "key", "left").groupBy("part", "row", "doc_id", "n", "start").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "size"))).alias("parts"))

    def run(batches):
        for b in batches:
            parts = column(b, "parts").to_pylist()
            counts = [[p["size"] for p in x] for x in parts]
            for n, c in zip(column(b, "n").to_pylist(), counts, strict=True):
                if None in c or sum(c) != n:
                    raise ValueError("a recipe names a chunk that the store does not hold")
            crc = joined_crc([[p["crc"] for p in x] for x in parts], counts)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "start"), column(b, "n"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.select("doc_id", "start", "n", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` (binary, as stored) of every document, rebuilt from its recipe."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    uses = spark.read.parquet(f"{folder}/recipes").select("part", "row", "doc_id", "start", F.posexplode("keys").alias("at", "key"))
    docs = uses.join(chunks, "key").groupBy("part", "row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return docs.select("doc_id", "start", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def query(spark, sf_dir):
    path = token_path("byte_bpe_50k.json")
    folder = new_path(spark, "token-store")
    write_store(documents(spark, sf_dir), folder, path)
    verify_manifest(spark, folder)
    return read_digests(spark, folder, encoder(path).width)
