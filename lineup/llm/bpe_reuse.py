"""Operator 4: BPE encoding and decoding with content-defined chunk reuse.

Each text is cut into chunks where a rolling hash of its last bytes hits a mask, wherever that is, also inside a word. Documents
are routed by the smallest chunk hash (documents that share most chunks share it), so a chunk that many documents hold is encoded
once in a task and the ids and decoded tokens of its body, from its first to its last word gap, are reused. The rest of two chunks around a cut
is a joint: it is encoded as one string, so a word that was cut is whole again. Then every joint is checked against the library: the joint with
the words on both sides is encoded at once and compared with the joined ids; while they differ, the joint takes in those words and is encoded and
checked again.

Nulls and empty texts give no ids and an empty decoded text. Texts of any length are processed whole; repeated rows give
repeated rows; an empty table gives an empty result. Columns beyond the id and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import _BYTE, column, mix64, utf8
from lineup.llm.tokens import Encoder, encoder, token_path, wide

#: Mean chunk of about 512 bytes; a cut needs at least MIN_CHUNK characters before it.
MASK = np.uint64(511)
SPAN = 12
MIN_CHUNK = 128
#: Bytes of chunk text whose ids one worker keeps.
KEEP_BYTES = 96 << 20
#: Texts that are encoded together.
BATCH = 400


def rolling_cuts(data: bytes) -> np.ndarray:
    """Byte positions after which the rolling hash of the last ``SPAN`` bytes hits the mask."""
    raw = _BYTE[np.frombuffer(data, dtype=np.uint8)]
    if len(raw) < SPAN:
        return np.zeros(0, dtype=np.int64)
    n = len(raw) - SPAN + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(SPAN):
        total += raw[j : j + n] << np.uint64(j)
    return np.flatnonzero(((total >> np.uint64(20)) & MASK) == 0) + SPAN


def chunks(text: str) -> list[str]:
    """Content-defined chunks that join to the text; a cut moves on to the next character border only."""
    data = utf8(text)
    out, last = [], 0
    for cut in rolling_cuts(data).tolist():
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if cut - last >= MIN_CHUNK and cut < len(data):
            out.append(data[last:cut].decode("utf-8", "surrogatepass"))
            last = cut
    out.append(data[last:].decode("utf-8", "surrogatepass"))
    return out


def _gap(text: str, at: int, step: int) -> int:
    """The next place from ``at`` on (``step`` 1) or back (-1) where a space follows a character that is no white space; -1 if there is none."""
    while True:
        at = text.find(" ", at) if step > 0 else text.rfind(" ", 0, at + 1)
        if at <= 0:
            return -1
        if not text[at - 1].isspace():
            return at
        at += step


def split_chunk(chunk: str) -> tuple[str, str, str]:
    """Head, body and tail of a chunk; a chunk without two gaps is all head."""
    a = _gap(chunk, 1, 1)
    z = _gap(chunk, len(chunk) - 1, -1)
    return (chunk[:a], chunk[a:z], chunk[z:]) if 0 < a < z else (chunk, "", "")


class ChunkEncoder:
    """Ids and tokens by chunk, with a bounded table of chunks that were seen."""

    def __init__(self, enc: Encoder):
        self.enc, self.table, self.size = enc, {}, 0
        self.joints: dict[tuple[str, str, str], bool] = {}
        self.repairs = 0

    def _learn(self, bodies: set[str]) -> None:
        """Encode bodies that the table does not hold, together."""
        new = [c for c in bodies if c not in self.table]
        if self.size > KEEP_BYTES:
            self.table, self.size = {}, 0
            new = list(bodies)
        for c, ids in zip(new, self.enc.encode_batch(new), strict=True):
            self.table[c] = ids, " ".join(self.enc.tokens(ids))
            self.size += 10 * len(c)

    def _agree(self, windows: set[tuple[str, str, str]]) -> None:
        """Whether the library's ids of a whole window are those of its three parts."""
        new = [w for w in windows if w not in self.joints]
        if len(self.joints) + len(new) > 200_000:
            self.joints.clear()
            new = list(windows)
        whole = self.enc.tokenizer.encode_batch_fast(["".join(w) for w in new], add_special_tokens=False)
        parts = self.enc.encode_batch([p for w in new for p in w])
        for k, (w, e) in enumerate(zip(new, whole, strict=True)):
            self.joints[w] = array(self.enc.code, e.ids).tobytes() == b"".join(parts[3 * k : 3 * k + 3])

    def batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids of each whole text, and its tokens joined by one space."""
        # per text: joint, body, joint, body, ..., joint
        rows = []
        for t in texts:
            row = [""]
            for head, body, tail in map(split_chunk, chunks(t) if t else []):
                row[-1] += head
                if body:
                    row += [body, tail]
            rows.append(row)
        todo = {n: list(range(0, len(r), 2)) for n, r in enumerate(rows) if len(r) > 1}
        while todo:  # joints that do not agree take in a word on each side, until they do
            at = {(n, k): window(rows[n], k) for n, ks in todo.items() for k in ks}
            self._agree(set(at.values()))
            todo = {}
            for (n, k), w in at.items():
                if not self.joints[w] and (w[0] or w[2]):
                    row = rows[n]
                    if (k and not row[k - 1].endswith(w[0])) or (k + 1 < len(row) and not row[k + 1].startswith(w[2])):
                        todo.setdefault(n, []).append(k)  # the joint before has just taken the body's only word
                        continue
                    row[k] = "".join(w)
                    if k:
                        row[k - 1] = row[k - 1][: len(row[k - 1]) - len(w[0])]
                    if k + 1 < len(row):
                        row[k + 1] = row[k + 1][len(w[2]) :]
                    self.repairs += 1
                    todo.setdefault(n, []).append(k)
        self._learn({b for r in rows for b in r[1::2] if b})
        joints = iter(self.enc.encode_batch([j for r in rows for j in r[::2]]))
        out = []
        for r in rows:
            got = []
            for k, part in enumerate(r):
                if k % 2:
                    got.append(self.table[part] if part else (b"", ""))
                else:
                    ids = next(joints)
                    got.append((ids, " ".join(self.enc.tokens(ids))))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out


def window(row: list[str], k: int) -> tuple[str, str, str]:
    """The last word of the body before a joint, the joint, and the first word of the body after it."""
    left, right = row[k - 1] if k else "", row[k + 1] if k + 1 < len(row) else ""
    a, z = _gap(left, len(left) - 1, -1), _gap(right, 1, 1)
    return left[max(a, 0) :], row[k], right[: z if z > 0 else len(right)]


_CHUNKED: dict[str, ChunkEncoder] = {}


def _route(batches):
    for b in batches:
        keys = []
        for text in column(b, "text").to_pylist():
            data = utf8(text)
            cuts = rolling_cuts(data)
            if len(cuts):
                # a chunk is told by the bytes before its cut
                ends = np.frombuffer(data, dtype=np.uint8)
                at = cuts[cuts >= 32]
                marks = np.zeros(len(at), dtype=np.uint64)
                for j in range(32):
                    marks = marks * np.uint64(0x100000001B3) + ends[at - 32 + j]
                keys.append(int(mix64(marks).min() >> np.uint64(1)) if len(at) else 0)
            else:
                keys.append(0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "bin"])


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of each row's whole text.

    ``digests`` gives the counts and digests of those two columns in place of them. The routing
    shuffle moves each text once; hot bins are split by the adaptive rebalance, so no task gathers a group of copies.
    """
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = df.schema[doc_id].dataType.simpleString()
    src = src.mapInArrow(_route, f"doc_id {kind}, text string, bin long").hint("rebalance", "bin")

    def run(batches):
        enc = encoder(path)
        if enc.suffix is False:
            raise ValueError("only tokenizers whose decoder is absent join tokens with spaces")
        chunked = _CHUNKED.setdefault(path, ChunkEncoder(enc))
        for b in batches:
            texts = column(b, "text").to_pylist()
            got = [x for at in range(0, len(texts), BATCH) for x in chunked.batch(texts[at : at + BATCH])]
            ids, texts = [g[0] for g in got], [g[1] for g in got]
            if digests:
                cols = [
                    pa.array([len(x) // enc.width for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(wide(x, enc.width).tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([wide(x, enc.width).tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *cols], names=names)

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return src.mapInArrow(run, f"doc_id {kind}, {out}")


def query(spark, sf_dir):
    from lineup.llm.common import documents

    return encode_documents(documents(spark, sf_dir), token_path("word_bpe_49k.json"), digests=True)
