"""Operators 11 to 13 against plain versions, and the borders of operators 1, 2 and 7."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineup.llm import chat, collocations, resampling, vectors, winnowing


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "z", 1) for d, t, lang in rows], "doc_id long, text string, lang string, cell string, guest int")


def corpus(n=60):
    r = random.Random(8)
    word = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "ió", "ou", "ß")]
    rows = [(k * 7 - 50, " ".join(r.choice(word) for _ in range(r.choice([1, 2, 5, 12, 40, 300]))), "en") for k in range(n)]
    rows += [(9000, rows[3][1], "en"), (9001, rows[3][1], "de"), (9002, None, None), (9003, "", "en"), (9004, "x" * 3000, "de"), (9005, "  \n\t ", "en"), (9006, "a a a a " * 500, "en")]
    return rows


# operator 11


def kept(text):
    value = [zlib.crc32(u.encode()) % winnowing.PRIME for u in re.findall(winnowing.UNIT, text)]

    def poly(x):
        out = 0
        for c in x:
            out = (out * winnowing.BASE + c) % winnowing.PRIME
        return out

    grams = [poly(value[i : i + winnowing.K]) for i in range(max(1, len(value) - winnowing.K + 1))] if value else []
    out = []
    for i in range(max(1, len(grams) - winnowing.W + 1) if grams else 0):
        window = grams[i : i + winnowing.W]
        least = min(window)
        at = i + max(k for k, x in enumerate(window) if x == least)
        if not out or out[-1][0] != at:
            out.append((at, least))
    return out


def share(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_fingerprints(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] or ""))
    for k, (d, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), kept(t), kept(edited), share(kept(t), kept(edited)), share(kept(t), kept(following))


@pytest.mark.parametrize(("block", "cells"), [(4096, (1000, 100_000)), (16, (5, 5)), (1, (1, 1))])
def test_winnowing(spark, monkeypatch, block, cells):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    monkeypatch.setattr(winnowing, "CELLS", cells)
    rows = corpus() + [(9000, "again one id", "en"), (9000, "again one id", "en")]
    show = F.transform(winnowing.fingerprint(F.col("text")), lambda x: F.struct(x["place"], x["hash"]))
    got = winnowing.fingerprints(docs(spark, rows))
    assert set(got.select("doc_id").distinct().toPandas()["doc_id"]) == {r[0] for r in rows}
    text = lambda x: " ".join(f"{h:08x}" for _, h in x)
    out = got.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), winnowing._text(F.col("packed")), winnowing._text(F.col("edited_packed")), "near_edited", "near_next")
    want = [(d, n, sha, text(a), text(b), x, y) for d, n, sha, a, b, x, y in plain_fingerprints(rows)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    for r in docs(spark, rows).select("text", show.alias("f")).collect():
        assert [tuple(x) for x in r["f"]] == kept(r["text"] or "")


def test_winnowing_guarantee_and_nulls(spark):
    r = random.Random(1)
    shared = " ".join(f"w{r.randrange(99)}" for _ in range(winnowing.W + winnowing.K - 1))
    one = " ".join(f"a{r.randrange(99)}" for _ in range(30)) + " " + shared + " " + " ".join(f"b{k}" for k in range(9))
    two = "start " + shared + " " + " ".join(f"c{k}" for k in range(50))
    df = spark.createDataFrame([(one, two)], "a string, b string")
    found = df.select(winnowing.matches(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b"))).alias("m")).first()["m"]
    assert any(x["a"] - x["b"] == 29 and 30 <= x["a"] <= 41 for x in found)
    rows = [(None, "some words here", "en"), (None, None, "en"), (5, None, "en")]
    got = {(x["doc_id"], x["n_chars"]): (x["near_edited"], x["near_next"]) for x in winnowing.fingerprints(docs(spark, rows)).collect()}
    assert got[5, 0] == (1.0, 1.0) and got[None, 15][1] is None and got[None, 0] == (1.0, None)
    assert winnowing.fingerprints(docs(spark, [])).isEmpty()
    assert winnowing.fingerprints(docs(spark, [(1, "alone here", "en")])).first()["near_next"] == 1.0


def test_winnowing_uses_no_python(spark):
    plan = winnowing.fingerprints(docs(spark, corpus(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# operator 12


def plain_collocations(rows, longest, least, first):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in often.items():
        inside = any(q[0] == lang and len(q[1]) > len(p) and b >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in often.items())
        if len(p) > 1 and not inside:
            cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for k, (s, a, p, left, right) in enumerate(sorted(v)[:first], 1)}


def test_collocations(spark, monkeypatch):
    r = random.Random(3)
    word = "the of New york city is big Straße, and. x".split()
    rows = [(k, " ".join(r.choice(word) for _ in range(r.randrange(60))) + r.choice(["", "! new York City is", "\nthe the the the"]), r.choice(["en", "de", None])) for k in range(120)]
    want = plain_collocations(rows, 5, 6, 40)
    assert len(want) > 60
    for part, held, partitions in ((262144, 1 << 21, None), (7, 50, 3)):
        monkeypatch.setattr(collocations, "_PART", re.compile(rb"(?s).{1,%d}[^\x20\x09.,;:!?\x0A-\x0D]*" % part))
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "PARTITIONS", (partitions or 512, 1 << 16))
        got = collocations.collocations(docs(spark, rows), 5, 6, 40)
        assert {tuple(x) for x in got.collect()} == want
    assert collocations.collocations(docs(spark, []), 5, 6).isEmpty()
    assert collocations.collocations(docs(spark, [(1, None, "en"), (2, "", None), (3, "one two", "en")])).isEmpty()


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(4)
    keys = np.concatenate([np.repeat(np.arange(30), 120), rng.integers(1000, 200_000, 60_000)]).astype(np.uint64)
    rng.shuffle(keys)
    summary = collocations.MisraGries(len(keys) // 100 + 1)
    for chunk in np.array_split(keys, 40):
        summary.merge(*np.unique(chunk, return_counts=True))
    assert summary.mass == len(keys) and 0 < summary.off < 100 and len(summary.keys) <= summary.capacity
    true = Counter(keys.tolist())
    assert set(range(30)) <= set(summary.survivors(100).tolist())
    assert all(true[k] - summary.off <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


# operator 13


def test_span_crcs_are_zlibs():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    start = rng.integers(0, 30_000, 400)
    length = np.concatenate([rng.integers(1, 70, 300), [63, 64, 65, 128, 129, 192], rng.integers(64, 9_000, 94)])
    got = resampling.span_crcs(data, start, start + length)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start.tolist(), length.tolist())]


def features(text, orders):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return w, [b" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, orders, buckets, least_words, percent):
    f = {d: features(t, orders) for d, t, _ in rows}
    of = lambda x: zlib.crc32(x) % buckets
    s, t = Counter(of(x) for _, v in f.values() for x in v), Counter(of(x) for text in target for x in features(text, orders)[1])
    S, T = sum(s.values()), sum(t.values())
    out = {}
    for d, (w, v) in f.items():
        gain = [math.floor(1000 * math.log((t[of(x)] + 1) * (S + buckets) / ((s[of(x)] + 1) * (T + buckets)))) for x in v]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(v), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    able = sorted((d for d in out if out[d][4] >= least_words), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(able[: percent * len(able) // 100], 1):
        out[d][3] = k
    return {d: tuple(v[:4]) for d, v in out.items()}


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling(spark, monkeypatch, orders):
    rows = [(d, t, lang) for d, t, lang in corpus() if d != 9001] + [(9100, "Long" + "word" * 100 + " again-again, Ünï " * 30, "en")]
    target = ["ba be da de", None, "ka ke kou"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    want = plain_resample(rows, target, orders, 97, 3, 30)
    assert len([1 for v in want.values() if v[3]]) > 5
    for piece in (65536, 5):
        monkeypatch.setattr(resampling, "_PIECE", re.compile(rb"(?s).{1,%d}[0-9a-z\x80-\xFF]*" % piece))
        got = resampling.resample(docs(spark, rows), t, orders, 97, least_words=3, percent=30)
        assert {x["doc_id"]: (x["n_features"], x["weight"], x["score"], x["rank"]) for x in got.collect()} == want
    picked = resampling.drawn(docs(spark, rows), t, orders=orders, buckets=97, least_words=3, percent=30)
    assert {x["doc_id"] for x in picked.collect()} == {d for d, v in want.items() if v[3]}


def test_resampling_edges(spark):
    t = spark.createDataFrame([], "text string")
    assert resampling.resample(docs(spark, []), t).isEmpty()
    rows = [(None, "one two " * 20, "en"), (1, "one two " * 20, "en"), (1, "one two " * 20, "en"), (2, None, "en")]
    got = resampling.resample(docs(spark, rows), t, percent=100).collect()
    assert len(got) == 4 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert [(r["n_features"], r["weight"], r["rank"]) for r in got if r["doc_id"] == 2] == [(0, 0, None)]


# borders of earlier operators


@pytest.mark.parametrize("texts", [["<", "|turn|>assistant\nhi"], ["a</", "s>[IN", "ST] z"], ["<", "", "|image:0:1|>"], ["~", "3", "~", "0"], ["", "x", ""]])
def test_no_control_string_forms_across_parts(spark, texts):
    part = lambda t: {"kind": "text", "text": t, "ref": None, "units": None}
    rows = [(1, 0, "user", [part(t) for t in texts]), (1, 1, "assistant", [part("ok"), part("<")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PART}".replace("parts struct", "parts array<struct") + ">")
    made = chat.format_chats(df)
    written = made.first()["formatted"]
    assert written.count("<|turn|>") == 2 and "</s>" not in written and "[INST]" not in written and "<|image" not in written
    back = chat.read_back(made).first()
    assert [(t["role"], t["content"]) for t in back["turns"]] == [("user", "".join(texts)), ("assistant", "ok<")]
    assert [p["text"] for p in back["turns"][0]["parts"]] == [t for t in texts if t]
    assert back["loss_text"] == "ok<"


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_cosine_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    scale = np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))
    plain = vectors.nearest(vectors_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]), every=5)
    scaled = vectors.nearest(vectors_of(spark, [(k, (v * s).tolist()) for k, (v, s) in enumerate(zip(x, scale))]), every=5)
    a, b = ({(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()} for df in (plain, scaled))
    assert len(a) == 60 and a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], abs_tol=1e-12) for k in a)


def test_products_of_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1e160, 0.0]), (3, [0.5, 0.5]), (4, [-1e308, 1e308])]
    got = vectors.largest_products(vectors_of(spark, rows[:4]), k=2)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 256 * 768 + 512 * 256), (0, 2, 3, 256 * 128 + 512 * 128)]
    for bad in (rows[:1] + [(7, [1e160, 0.0])], rows[:2] + rows[4:]):
        with pytest.raises(Exception):  # beyond a bigint: an error, never a row that is missing
            vectors.largest_products(vectors_of(spark, bad), k=5).collect()
