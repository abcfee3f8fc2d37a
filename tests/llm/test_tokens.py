import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lineup.llm import bpe_reuse, packing, token_store
from lineup.llm.tokens import Encoder, encoder, token_path

ODD = ["a<|endoftext|>b <|startoftext|>", "  lead  \n\n x\t y", "it's  DON'T we'll\n\n\n", "é ́x İΣΑΣ ΟΔΟΣ. 12345", "", "   ", " a", "a \n b", "x!? . ,, ;a", "日本語 🙂 ok", "a\x1c\x1cb c", "Ünï-cödé 's", "hello world!!!  \n", "don’t 'S 'LL"]


def texts(n=300):
    r = random.Random(3)
    alphabet = "ab A.,!'sS\n\t  éΣ<|>1_-\x0b\x0c\r"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = Encoder(token_path(name), pieces=50)  # a tiny table, so that it turns over
    assert all(a == e.plain(t) for a, t in zip(e.encode_batch(texts()), texts()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, n string")


ROWS = [(k, t, ["a", "b", None][k % 3], "x", "y") for k, t in enumerate(texts(20))] + [(90, None, "a", "x", "y"), (91, "the cat sat on the mat, " * 2000, "a", "x", "y"), (91, "the cat sat on the mat, " * 2000, "a", "x", "y")]


def test_chunk_reuse_is_exact(spark):
    tk = Tokenizer.from_file(token_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in bpe_reuse.encode_documents(frame(spark, ROWS), token_path("word_bpe_49k.json"), digests=True).collect()}
    for doc, text, *_ in ROWS:
        ids = tk.encode(text or "", add_special_tokens=False).ids
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_reuse.encode_documents(frame(spark, []), token_path("word_bpe_49k.json")).count() == 0


def test_chunks_join_to_the_text():
    for t in ["", "x" * 5000, "word gap " * 900]:
        assert "".join(bpe_reuse.chunks(t)) == t


def test_packing_places_each_id_once(spark):
    enc = encoder(token_path("word_bpe_49k.json"))
    got = packing.pack(frame(spark, ROWS), token_path("word_bpe_49k.json"), length=256).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for doc, text, *_ in ROWS[:-1]:
        ids = np.frombuffer(enc.encode(text), enc.dtype).astype("<u4").tobytes() + (2).to_bytes(4, "little")
        copies = 2 if doc == 91 else 1
        pieces = sorted({(r["start"], r["length"], r["ids"], r["ids_crc32"]) for r in by_doc[doc]}) if copies == 1 else None
        total += copies * len(ids) // 4
        if pieces:
            assert b"".join(p[2] for p in pieces) == ids and all(zlib.crc32(p[2]) == p[3] for p in pieces)
    sizes = []
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert sum(sizes) == total and all(s == 256 or s & (s - 1) == 0 for s in sizes)
    assert packing.pack(frame(spark, []), token_path("word_bpe_49k.json")).count() == 0


def test_mixture_follows_shares():
    mix = packing.Mixture([1000, 3000, 96], 64)
    for w in range(mix.windows):
        given = mix.given(w)
        assert sum(given) == w * 64 and all(abs(g - 64 * w * n / 4096) < 3 for g, n in zip(given, mix.totals))
    assert mix.window_of(1, 0) == 0 and mix.given(mix.window_of(2, 95))[2] <= 95


def test_store_round_trip(spark, tmp_path):
    enc = encoder(token_path("byte_bpe_50k.json"))
    folder = str(tmp_path / "store")
    token_store.write_store(frame(spark, ROWS), folder, token_path("byte_bpe_50k.json"))
    token_store.verify_manifest(spark, folder)
    digests = sorted(token_store.read_digests(spark, folder, enc.width).collect(), key=lambda r: r["start"])
    full = sorted(token_store.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for (doc, text, *_), d, f in zip(sorted(ROWS, key=lambda r: r[0]), digests, full, strict=True):
        ids = np.r_[np.frombuffer(enc.encode(text), enc.dtype).astype("<u4"), np.array([0], "<u4")]
        assert (d["doc_id"], d["start"], d["n_tokens"], d["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        assert bytes(f["ids"]) == ids.astype(enc.dtype).tobytes()
        at += len(ids)
    keys = [bytes(r["key"]) for r in spark.read.parquet(f"{folder}/chunks").collect()]
    assert len(keys) == len(set(keys))


def test_damaged_chunk_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "store")
    token_store.write_store(frame(spark, ROWS[:5]), folder, token_path("byte_bpe_50k.json"))
    spark.read.parquet(f"{folder}/chunks").withColumn("ids", F.concat("ids", F.lit(b"\x01\x00"))).write.parquet(str(tmp_path / "bad" / "chunks"))
    spark.read.parquet(f"{folder}/recipes").write.parquet(str(tmp_path / "bad" / "recipes"))
    with pytest.raises(Exception, match="does not match its key"):
        token_store.read_digests(spark, str(tmp_path / "bad"), 2).collect()


def test_targets_hold_until_a_queue_is_dry():
    mix = packing.Mixture([5000, 3000, 2000, 96], 64, [1 << 29, 1 << 28, 1 << 28, 0])
    dry = mix.phases[1][0]  # the first queue ends after 10,000 tokens, the two others just before or with it
    assert 7900 <= dry <= 8100 and sum(mix.given(mix.windows)) == 10096 and mix.given(mix.windows) == mix.totals
    for w in range(mix.windows):
        a, z = mix.given(w), mix.given(w + 1)
        assert all(x <= y for x, y in zip(a, z)) and sum(a) == mix.border(w)
        assert all(abs(d) < 4 for d in mix.deficits(w))
        if mix.border(w + 1) <= dry:  # half, a quarter, a quarter, nothing of the source without a target
            assert all(abs((y - x) - t) <= 2 for x, y, t in zip(a, z, (32, 16, 16, 0))) and z[3] == 0
    assert packing.Mixture([], 64).windows == 0


def test_packing_with_targets(spark):
    rows = [(k, "the cat sat on the mat " * (3 + k % 5), ["a", "b", None, "c"][k % 4], "x", "y") for k in range(400)]
    df, path, targets = frame(spark, rows), token_path("word_bpe_49k.json"), {"a": 0.6, "b": 0.3, None: 0.1}
    source, n = {d: s for d, _, s, *_ in rows}, {}
    for r in packing.pack(df.repartition(7), path, length=128, targets=targets).collect():
        key = (r["sequence_id"], source[r["doc_id"]])
        n[key] = n.get(key, 0) + r["length"]
    report = packing.mixture_report(df.repartition(7), path, targets, length=128).collect()
    assert {(r["sequence_id"], r["source"]): r["tokens"] for r in report if r["tokens"]} == n
    first = [w for w in range(5)]
    for w in first:  # before any queue is dry
        assert abs(n[w, "a"] - 76.8) < 3 and abs(n[w, "b"] - 38.4) < 3 and abs(n[w, None] - 12.8) < 3 and (w, "c") not in n
    assert all(abs(r["deficit"]) < 4 for r in report) and any(r["deficit"] != 0 for r in report)


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 5)
    rows = [(k, "word " * (k % 9), f"source {k % 40}", "x", "y") for k in range(200)]
    got = packing.pack(frame(spark, rows), token_path("word_bpe_49k.json"), length=64, targets={"source 3": 1.0}).collect()
    assert {r["doc_id"] for r in got} == set(range(200))
    sizes = {}
    for r in got:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert sum(sizes.values()) == sum(r["doc_tokens"] for r in got if r["start"] == 0) and all(s == 64 or s & (s - 1) == 0 for s in sizes.values())
    assert {r["sequence_id"] for r in got if r["doc_id"] % 40 == 3} == {0}


def test_cut_words_are_joined_and_repaired(monkeypatch):
    r = random.Random(6)
    path = token_path("word_bpe_49k.json")
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 12))) for _ in range(60)]
    long = [" ".join(r.choice(words) + r.choice(["", ",", "'s", ".\n"]) for _ in range(900)) for _ in range(6)] + ["x" * 3000, "ab " * 2000, "日本" * 900, "a\x85b " * 700, "é ́" * 400]
    own = bpe_reuse.ChunkEncoder(Encoder(path))
    inside = [c for t in long for c in bpe_reuse.chunks(t)[1:] if not c[0].isspace()]
    assert len(inside) > 20  # cuts stand inside words
    tk = Tokenizer.from_file(path)
    for t, (ids, tokens) in zip(long, own.batch(long)):
        want = tk.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, own.enc.dtype).tolist() == want and tokens == tk.decode(want, skip_special_tokens=False)
    # an encoder that is wrong on parts that begin with a space is found out and the joints grow until they agree
    wrong = bpe_reuse.ChunkEncoder(Encoder(path))
    honest, first = wrong.enc.encode_batch, long[0]
    bad = {w for row in [first] for k, w in enumerate(row.split(" ")) if k % 7 == 0}
    monkeypatch.setattr(wrong.enc, "encode_batch", lambda texts: [b"" if t.strip() in bad and t.startswith(" ") and len(t) < 16 else x for t, x in zip(texts, honest(texts))])
    wrong.batch([first])
    assert wrong.repairs > 0


def test_store_has_one_root_that_covers_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 2)  # several levels
    rows = ROWS + [(None, "no id", "a", "x", "y"), (None, None, "a", "x", "y")]
    path, roots = token_path("byte_bpe_50k.json"), []
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    for name, data in (("a", rows), ("b", rows[::-1]), ("c", [(0, "changed", "a", "x", "y"), *rows[1:]])):
        folder = str(tmp_path / name)
        token_store.write_store(frame(spark, data), folder, path)
        token_store.verify_manifest(spark, folder)
        roots.append(token_store.store_root(spark, folder))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert roots[0] and roots[2] and roots[0] != roots[2]
    got = token_store.read_digests(spark, str(tmp_path / "a"), 2).orderBy("start").collect()
    assert [r["doc_id"] for r in got][:2] == [None, None] and len(got) == len(rows)
    top = spark.read.parquet(str(tmp_path / "a" / "roots"))
    assert top.groupBy("level").count().orderBy("level").collect()[-1]["count"] == 1
    spark.read.parquet(str(tmp_path / "a" / "manifest")).drop("root").withColumn("root", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(b"x" * 16)).write.parquet(str(tmp_path / "bad" / "manifest"))
    for part in ("recipes", "roots", "chunks"):
        spark.read.parquet(str(tmp_path / "a" / part)).write.parquet(str(tmp_path / "bad" / part))
    with pytest.raises(ValueError):
        token_store.verify_manifest(spark, str(tmp_path / "bad"))
    empty = str(tmp_path / "none")
    token_store.write_store(frame(spark, []), empty, path)
    token_store.verify_manifest(spark, empty)
    assert token_store.store_root(spark, empty) is None


def test_pieces_and_store_hold_the_librarys_ids(spark, tmp_path):
    """Against the tokenizers library itself, with a document that occurs twice."""
    word, byte = Tokenizer.from_file(token_path("word_bpe_49k.json")), Tokenizer.from_file(token_path("byte_bpe_50k.json"))
    at = {}
    for p in packing.pack(frame(spark, ROWS), token_path("word_bpe_49k.json"), length=256).collect():
        at.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for doc in {r[0] for r in ROWS}:
        own = [t or "" for d, t, *_ in ROWS if d == doc]
        ids = [*word.encode(own[0], add_special_tokens=False).ids, 2]
        # pieces of equal copies are cut at different places, so they are put in by place and have to agree
        whole, seen = [None] * len(ids), 0
        for start, raw, n in at[doc]:
            assert n == len(ids)
            for k, v in enumerate(np.frombuffer(raw, "<u4").tolist()):
                assert whole[start + k] in (None, v)
                whole[start + k] = v
                seen += 1
        assert whole == ids and seen == len(own) * len(ids)
    folder = str(tmp_path / "store")
    token_store.write_store(frame(spark, ROWS), folder, token_path("byte_bpe_50k.json"))
    stored = sorted((r["doc_id"], bytes(r["ids"])) for r in token_store.read_documents(spark, folder).collect())
    want = sorted((d, np.array([*byte.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes()) for d, t, *_ in ROWS)
    assert stored == want
