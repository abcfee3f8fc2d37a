"""Shared helpers: durable intermediate tables, document hashing, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where it is unset (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lineup-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _draws(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _draws(256, 11)
_P = 0x5851F42D4C957F2D
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


#: About 64 KB that end with a whole word, so that the hashing of a very long text needs no arrays of its length.
_PIECE = re.compile(rb"(?s).{1,65536}[^\x20\x09-\x0D]*")
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; the tables grow with the longest piece, so with the longest word."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, p, dtype=np.uint64))]) for p in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _TABLES


def pieces(data: bytes):
    """The text in pieces of whole words."""
    return [data] if len(data) <= 65536 else (m.group() for m in _PIECE.finditer(data))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of ``data``, a piece of whole words at a time."""
    if len(data) <= 65536:
        return _piece_hashes(data)
    parts = [_piece_hashes(x) for x in pieces(data)]
    return np.concatenate([np.zeros(0, dtype=np.uint64), *parts])


def _piece_hashes(data: bytes) -> np.ndarray:
    """A polynomial over random byte values for each word, from running sums over the piece, then mixed."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([np.zeros(int(not space[0]), np.int64), edge, np.full(int(not space[-1]), len(raw))])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(65536, len(raw)) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words, from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix64(total)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of the text, lower-cased in A-Z; shorter texts are one shingle."""
    words = word_hashes(lower_ascii(utf8(text)))
    if not len(words):
        return words
    if len(words) < k:
        return gram_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(gram_hashes(words, k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def values_of(batch: pa.RecordBatch, name: str):
    """The values of a column one after the other, so that a batch of long texts or lists is not held twice."""
    return (value.as_py() for value in column(batch, name))


def fixed(values: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as the rows of a byte matrix."""
    data = b"".join(v.as_buffer() for v in values)
    return np.frombuffer(data, dtype=np.uint8).reshape(len(values), width)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the Arrow batches of a session by rows and bytes, so that long texts do not fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


SAFE_NAME = re.compile(r"\W+")
