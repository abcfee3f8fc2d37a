"""Operator 8: quality classifier, hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

Tokens are runs of letters, digits and bytes above 127, and runs of other marks; unigrams and bigrams (a word after itself also counts as one common bigram) are
hashed into ``2^18`` slots with counts scaled to unit length. Training uses labelled rows outside the held-out fold, a sample by a hash of doc_id of about
``SAMPLE`` rows (the documented bound); ``SHARDS`` learners each pass over their rows until they have made ``UPDATES`` per-coordinate FTRL-proximal updates,
and their weights are averaged. The weights, of fixed size, are broadcast; every text is scored whole as a sparse
dot product.

Defined results: null and empty texts have no features and score the intercept; rows without a label are only scored; null labels or ids
do not train, rows with a null id are not held out; of several labels of an id the smallest counts; without any label every score is 0.5;
repeated rows give repeated rows; extra columns are not read. Texts are counted whole, in pieces, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import _BYTE, _powers, documents, mix64, pieces, small_batches, utf8, values_of

SLOTS = 1 << 18
SAMPLE, SHARDS, UPDATES = 16_000, 4, 12_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.01
#: Documents under this score are rejected.
KEEP = 0.7
_KIND = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.int8)


def _tokens(data: bytes) -> np.ndarray:
    """A hash for each run of letters and digits and each run of marks."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    kind = _KIND[raw]
    edge = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(kind[1:] != kind[:-1]) + 1, np.full(1, len(raw))])
    up, down = _powers(max(65536, len(raw)) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    start, end = edge[:-1], edge[1:]
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))[kind[start] > 0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; slot 0 is the intercept. Long texts are counted a piece at a time."""
    found, last = [], np.zeros(0, dtype=np.uint64)
    for piece in pieces(utf8(text)):
        word = np.concatenate([last, _tokens(piece)])  # the last token of a piece starts a bigram with the next one
        again = word[1:] == word[:-1]  # a repeated word is one bigram whatever the word
        grams = np.concatenate([word[len(last) :], mix64(word[:-1] * np.uint64(3) + word[1:]), np.full(again.sum(), 12345, dtype=np.uint64)])
        found.append(np.unique((grams % np.uint64(SLOTS - 1)).astype(np.int32) + 1, return_counts=True))
        last = word[-1:]
        if len(found) == 64:
            found = [_joined(found)]
    slot, count = _joined(found)
    if not len(slot):
        return np.zeros(1, np.int32), np.ones(1)
    value = np.sqrt(count)
    return np.concatenate([np.zeros(1, np.int32), slot]), np.concatenate([np.ones(1), value / np.sqrt((value * value).sum())])


def _joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their counts over several pieces."""
    if len(found) == 1:
        return found[0]
    slot, place = np.unique(np.concatenate([np.zeros(0, np.int32), *(s for s, _ in found)]), return_inverse=True)
    return slot, np.bincount(place, np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]), minlength=len(slot))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str | None], labels: list[int]) -> np.ndarray:
    """FTRL-proximal weights of one shard."""
    rows = [features(t) for t in texts]
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.argsort(mix64(np.arange(len(rows), dtype=np.uint64)))
    for _ in range(-(-UPDATES // max(1, len(rows)))):
        for k in order.tolist():
            at, x = rows[k]
            w = weights(at)
            g = (sigmoid(w @ x) - labels[k]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(SLOTS))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from rows ``doc_id, text, label``; about ``sample`` rows train, the choice is a hash of doc_id."""
    total = labelled.count()
    part = min(1.0, sample / max(1, total))
    few = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < int(part * (1 << 20)))
    few = few.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        w = train(pdf["text"].tolist(), pdf["label"].astype(int).tolist()).astype(np.float32)
        return pd.DataFrame({"rows": [len(pdf)], "w": [w.tobytes()]})

    got = few.groupBy("shard").applyInPandas(run, "rows long, w binary").collect()
    weights = np.zeros(SLOTS)
    for r in got:
        weights += np.frombuffer(r["w"], dtype=np.float32) * (r["rows"] / sum(x["rows"] for x in got))
    return weights


def held_out(doc_id) -> F.Column:
    """Whether a row is never learned from; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1."""
    small_batches(docs.sparkSession)
    target = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_doc")).agg(F.min(label).alias("label"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the hash that picks the sample is applied to both sides before the join
    weights = docs.sparkSession.sparkContext.broadcast(fit(rows.join(target, rows["doc_id"] == target["label_doc"]).select("doc_id", "text", "label")).astype(np.float32))

    def run(batches):
        w = weights.value
        for b in batches:
            s = [float(sigmoid(w[at] @ x)) for at, x in map(features, values_of(b, text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def query(spark, sf_dir):
    rows = scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that the classifier rejects go."""
    from lineup.llm.common import free_name

    name = free_name(docs, "score")
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=name)
    return rows.where(F.col(name) >= KEEP).drop(name)
