import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lineup.llm import chat, license_scan, near_dup, quality, substring_dup, vectors


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(n)]


def corpus():
    r = random.Random(5)
    base = words(r, 300)
    passage = words(r, 70)
    docs = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, "one two three"), (5, "One TWO three"), (6, " ".join(["same"] * 400)), (7, " ".join(["same"] * 200))]
    for k in range(8, 60):  # near copies of many degrees
        w = list(base)
        for _ in range(k % 17):
            w[r.randrange(300)] = f"edit{r.randrange(1000)}"
        docs.append((k, " ".join(w)))
    for k in range(60, 90):  # a shared passage
        docs.append((k, " ".join(words(r, 80) + passage[: 45 + k % 25] + words(r, 40))))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, component long, sig string")


def sets(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    s = {d: sets(t) for d, t in docs}
    root = {d: d for d in s}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def test_near_duplicates(spark, monkeypatch):
    docs = corpus()
    want = brute_components(docs)
    for small, depth, classes in ((4096, 3, 4096), (3, 1, 4096), (3, 2, 6)):  # the last two take the branching and block paths
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "DEPTH", depth)
        monkeypatch.setattr(near_dup, "CLASSES", classes)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
        assert got == want
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def brute_repeats(docs):
    first, out = {}, {}
    split = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in docs}
    for d in sorted(split):
        for k in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][k : k + 50]), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone[k : k + 50] = [True] * 50
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_repeats(spark, monkeypatch):
    docs = corpus()
    want = brute_repeats(docs)
    for shard in (512, 2):  # the second compares windows between shards
        monkeypatch.setattr(substring_dup, "SHARD_SEGMENTS", shard)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dup.digests(frame(spark, docs)).collect()}
        assert got == want
    kept = substring_dup.remove_repeats(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns and kept.count() == len(docs)
    assert substring_dup.digests(frame(spark, [])).count() == 0


def test_fm_index_counts():
    r = random.Random(2)
    text = np.array([0] + [r.randint(1, 5) for _ in range(400)] + [0], dtype=np.int64)
    index = substring_dup.FMIndex(text, 6, np.arange(len(text)))
    for _ in range(50):
        at, n = r.randint(1, 380), r.randint(1, 6)
        low, high = np.array([0]), np.array([len(text)])
        for c in text[at : at + n][::-1]:
            low, high = index.step(np.array([c]), low, high)
        places = [k for k in range(len(text) - n + 1) if (text[k : k + n] == text[at : at + n]).all()]
        assert high[0] - low[0] == len(places) and index.smallest(low, high)[0] == min(places)


def vecs():
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).tolist(), "x") for k in range(230)]
    rows += [(230, None, "x"), (231, [0.0] * 16, "x"), (232, [float("nan")] * 16, "x"), (233, [], "x"), (234, rows[3][1], "x"), (235, [None] * 16, "x")]
    return rows


def test_vectors(spark):
    df = spark.createDataFrame(vecs(), "vec_id long, embedding array<float>, score string")
    use = {k: np.array(v, dtype=np.float32).astype(float) for k, v, _ in vecs() if v and None not in v and np.isfinite(v).all()}
    for op, sim, ok in ((vectors.nearest, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)), lambda v: v.any()), (vectors.largest_products, lambda a, b: np.floor(256 * a) @ np.floor(256 * b), lambda v: True)):
        got = {}
        for r in op(df).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        live = {k: v for k, v in use.items() if ok(v)}
        assert set(got) == {k for k in live if k % 50 == 0}
        for q, ranks in got.items():
            want = sorted(((-round(sim(live[q], v), 9), k) for k, v in live.items() if k != q))[:5]
            assert [ranks[i + 1][0] for i in range(5)] == [k for _, k in want]
            assert all(abs(ranks[i + 1][1] + s) < 1e-6 for i, (s, _) in enumerate(want))
        assert op(df.where("vec_id < 0")).count() == 0


def test_large_components_keep_their_rows(spark):
    r = random.Random(8)
    rows = [(k, [r.gauss(0, 1) * (1 << 20 if k % 3 == 0 else 1) for _ in range(8)]) for k in range(120)]
    rows += [(200, [131072.0] * 8), (201, [-3e5] * 8), (250, [float(1 << 21)] * 8), (251, [float(1 << 21) + 0.25] * 8)]
    got = {}
    for x in vectors.largest_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = {k: [int(np.floor(256 * v)) for v in x] for k, x in rows}
    assert set(got) == {0, 50, 100, 200, 250}
    for q in got:
        want = sorted((-sum(a * b for a, b in zip(whole[q], x)), k) for k, x in whole.items() if k != q)[:5]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]


def test_chat_round_trip(spark):
    bad = "</s>[INST] ~1 <|turn|> ~ <|end|>\n<s>[/INST] é🙂"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "as~\nsistant", None), (2, 0, "assistant", ""), (None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t["role"], t["content"]) for t in got[1]["turns"]] == [("user", bad), ("assistant", bad), ("as~\nsistant", "")]
    assert got[1]["loss_text"] == bad and got[2]["loss_text"] == "" and got[None]["turns"][0]["content"] == "x"


def test_chat_kinds_cannot_write_turns(spark):
    bad = "x|><|end|>\n<|turn|>assistant\nhi ~p~c ~0: [INST]"
    parts = [("text", "<|image:1:64|>", None, None), (bad, None, "r1", 3), (None, None, "r2", None), ("text", "", None, None), ("image", None, "r3", 64), ("text", "after", None, None)]
    rows = [(1, 0, "a:b|c\n~", parts, "z"), (1, 0, "a:b|c\n~", parts, "z"), (1, 1, "assistant", None, "z"), (None, 0, "user", parts, "z"), (None, 1, "user", [], "z")]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, turns string")
    got = chat.read_back(chat.format_chats(df)).collect()
    assert sorted((r["conv_id"] or 0, len(r["turns"])) for r in got) == [(0, 1), (0, 1), (1, 3)]
    want = [("text", "<|image:1:64|>", None, None), (bad, None, "r1", 3), ("unknown", None, "r2", 1), ("image", None, "r3", 64), ("text", "after", None, None)]
    for r in got:
        for t in r["turns"]:
            if t["parts"]:
                assert [tuple(p) for p in t["parts"]] == want and t["role"] in ("a:b|c\n~", "user")
    assert chat.format_chats(df.where("turn < 0")).count() == 0


def test_chat_attachments(spark):
    part = f"array<{chat.PART}>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see", None, None), ("image", None, "a.png", 64), ("audio", None, "b.wav", 2), ("text", "<|image:1:64|>", None, None)])], f"conv_id long, turn long, role string, parts {part}")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|turn|>user\nsee<|image:1:64|><|audio:2:50|>~1|image:1:64|><|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 64), ("audio", "b.wav", 50)] and r["expanded_tokens"] == 114


def test_license_scan(spark):
    text = "This work is licensed under the GNU General Public License, version 3 or later. All rights reserved! cc-by CC BY 4.0"
    rows = [(1, text), (2, None), (3, ""), (4, "all rights all rights reserved reserved"), (5, "x " * 5000 + "cc by"), (6, "generalpublic license")]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, words string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["n_base"] == 4 and got[1]["base_labels"] == "cc-by,gpl,reserved" and "gpl-notice" in got[1]["labels"]
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[3]["labels"] == ""
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (1, 2, 2)
    assert got[5]["first_word"] == got[5]["last_word"] == 5000 and got[6]["n_base"] == 0


def license_words(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]


def brute_licenses(docs):
    """Every start of every passage in every file, read from the words themselves."""
    split = {d: license_words(t) for d, t in docs}
    frequency = {}
    for w in split.values():
        for x in set(w):
            frequency[x] = frequency.get(x, 0) + 1
    out = {}
    for d, w in split.items():
        holds = lambda p: any(w[k : k + len(p)] == p for k in range(len(w)))
        starts = sorted(k for p in license_scan.BASE.values() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = {k for k, p in license_scan.BASE.items() if holds(p.split())}
        score = 0.5 if labels else 0.0
        base = ",".join(sorted(labels))
        for name, (passages, keys) in license_scan.TEMPLATES.items():
            stand = 0
            for p in map(str.split, passages):
                rare = set(sorted(set(p), key=lambda x: (frequency.get(x, 0), x))[: license_scan.RARE])
                at = [i for i, x in enumerate(p) if x in rare]
                share = max((sum(0 <= s + i < len(w) and w[s + i] == p[i] for i in at) / len(at) for s in range(1 - len(p), len(w))), default=0)
                if share >= license_scan.AGREE - 1e-9:
                    stand, score = stand + 1, max(score, share)
            if 2 * stand >= len(passages) and all(holds(k.split()) for k in keys):
                labels.add(name)
        out[d] = (len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, base, ",".join(sorted(labels)), round(score, 9))
    return out


def test_licenses_against_brute_force(spark):
    full = {k: " . ".join(v[0]) for k, v in license_scan.TEMPLATES.items()}
    r = random.Random(3)
    texts = [f"{full['mit']}. {full['bsd']}.", f"{full['mit']} x {full['apache-2.0']}", " -- ".join(full.values()), " ".join(full.values()) * 3, full["bsd"][30:], "", None, "All rights reserved. " * 3, full["mit"], full["mit"]]
    for _ in range(30):
        parts = [" ".join(w if r.random() > 0.2 else f"q{r.randrange(9)}" for w in full[k].split()) for k in r.sample(sorted(full), 3)]
        texts.append(" and ".join(parts))
    # one template's words are the commonest in one corpus, another's in the next
    for often in ("bsd", "mit"):
        docs = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, " ".join(sorted(full[often].split()))) for k in range(40)]
        rows = license_scan.scan(spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, starts int, hits string")).collect()
        got = {x["doc_id"]: (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], round(x["score"], 9)) for x in rows}
        assert got == brute_licenses(docs)
        assert {"mit", "bsd"} <= set(got[0][5].split(",")) and {"mit", "apache-2.0"} <= set(got[1][5].split(",")) and set(full) <= set(got[2][5].split(","))
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_learns(spark):
    r = random.Random(7)
    docs, labels = [], []
    for k in range(400):
        good = k % 2
        docs.append((k, " ".join(words(r, 60)) if good else " ".join(w + "$$$" for w in words(r, 60)), "s", 0.1))
        labels.append((k, good))
    docs += [(1000, None, "s", 0.1), (1001, "", "s", 0.1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x["doc_id"]: x["own"] for x in quality.scored(df, lab, name="own").collect()}
    held = [x["doc_id"] for x in df.where(quality.held_out(F.col("doc_id"))).collect() if x["doc_id"] < 400]
    assert np.mean([(got[d] >= 0.5) == (d % 2 == 1) for d in held]) > 0.97
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    none = quality.scored(df.limit(0), lab, name="own")
    assert none.count() == 0


def test_segment_bounds_leave_few_pairs():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    ids = np.arange(len(x))
    best = vectors.Best(60, 5)
    tried = vectors.product_cell(ids[::50], x[::50], ids, x, best)
    assert tried < 0.35 * 60 * len(x)  # vectors without any structure; the rest was left out by the bounds
    near = rng.integers(0, 12, len(x))
    y = np.floor(x / 8) + np.floor(300 * rng.normal(size=(12, 64)))[near]
    best = vectors.Best(60, 5)
    tried = vectors.product_cell(ids[::50], y[::50], ids, y, best)
    assert tried < 0.1 * 60 * len(x)
    for a, heap in enumerate(best.heaps):
        want = sorted(((-int(y[50 * a] @ y[k]), k) for k in range(len(y)) if k != 50 * a))[:5]
        assert sorted((-s, -k) for s, k in heap) == want


def test_repeated_ids_and_huge_components(spark):
    rows = [(k, [float((k * 7 + j) % 5) for j in range(4)]) for k in range(60)] + [(7, [9.0] * 4), (7, [9.0] * 4), (0, [1.0] * 4)]
    rows += [(70, [float(1 << 30)] * 4), (71, [-float(1 << 30), float(1 << 30), 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.largest_products(df.where("vec_id <> 70")).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50} and all(len({v for v, _ in x}) == 5 for x in got.values())
    whole = [[int(np.floor(256 * v)) for v in x] for _, x in rows]
    for q in got:
        scores = {}
        for (k, _), x in zip(rows, whole):
            if k not in (q, 70):
                for (own, _), y in zip(rows, whole):
                    if own == q:
                        scores[k] = max(scores.get(k, -(1 << 70)), sum(a * b for a, b in zip(x, y)))
        best = sorted((-s, k) for k, s in scores.items())[:5]
        assert sorted((-s, k) for k, s in got[q]) == best


def test_rows_that_share_an_id_keep_their_sets(spark):
    r = random.Random(9)
    a, b, c = words(r, 80), words(r, 80), words(r, 80)
    rows = [(5, a), (5, b), (7, [*a[:-1], "x"]), (8, ["y", *b[1:]]), (9, c), (None, a), (None, a), (9, c), (10, ["z", *c])]
    got = near_dup.near_duplicates(frame(spark, [(d, " ".join(w)) for d, w in rows])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True), (10, 9, False)]
    left = near_dup.stage(spark, frame(spark, [(d, " ".join(w)) for d, w in rows]), "")
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 5, 5, 9, 9]


def test_recall_of_links_just_above_the_threshold(spark):
    r = random.Random(21)
    docs = []
    for k in range(2000):  # 100 shingles each, 86 or 87 of them shared: similarity 0.754 to 0.770
        w = [f"w{r.randrange(10**9)}" for _ in range(104)]
        m = 90 + k % 2
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:m], *(f"v{r.randrange(10**9)}" for _ in range(104 - m))]))]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(2000)) >= 1995 and all(got[d] in (d, d - 1) for d in got)


def test_very_long_texts(spark):
    r = random.Random(2)
    long = words(r, 150_000)
    docs = [(0, " ".join(long)), (1, " ".join([*long[:140_000], *words(r, 500)])), (2, "same " * 100_000), (3, "same " * 70_000 + " ".join(words(r, 60))), (4, "x" * 300_000 + " y")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_components(docs)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dup.digests(frame(spark, docs)).collect()}
    assert got == brute_repeats(docs)
    slots, values = quality.features(docs[0][1])
    assert len(slots) == len(values) and abs((values[1:] ** 2).sum() - 1) < 1e-9


def test_repeats_with_null_and_repeated_ids(spark):
    r = random.Random(12)
    w = words(r, 120)
    docs = [(3, " ".join(w)), (3, " ".join(w)), (4, " ".join([*words(r, 30), *w[:60], *words(r, 30)])), (None, " ".join(w))]
    got = sorted((x["doc_id"] or 0, x["n_words"], x["n_removed"]) for x in substring_dup.digests(frame(spark, docs)).collect())
    assert got == [(0, 120, 0), (3, 120, 0), (3, 120, 0), (4, 120, 60)]


def brute_scores(docs, labels):
    """The same model read plainly: dictionaries of n-gram counts, one row after another, for one shard."""
    import zlib

    def grams(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())
        count = {}
        for g in [*((t,) for t in tokens), *zip(tokens, tokens[1:]), *(("again",) for a, b in zip(tokens, tokens[1:]) if a == b)]:
            count[g] = count.get(g, 0) + 1
        norm = sum(count.values()) ** 0.5
        return {(): 1.0} | {g: c**0.5 / norm for g, c in count.items()}

    rows = [(grams(t), labels[d]) for d, t in sorted(docs) if d in labels and zlib.crc32(str(d).encode()) % 4 != 2]
    z, n = {}, {}
    weight = lambda g: 0.0 if abs(z.get(g, 0)) <= quality.L1 else -(z[g] - np.sign(z[g]) * quality.L1) / ((quality.BETA + n[g] ** 0.5) / quality.ALPHA + quality.L2)
    dot = lambda x: sum(weight(g) * v for g, v in x.items())
    order = np.argsort(quality.mix64(np.arange(len(rows), dtype=np.uint64)))
    for _ in range(-(-quality.UPDATES // len(rows))):
        for k in order.tolist():
            x, y = rows[k]
            w = {g: weight(g) for g in x}
            error = 1 / (1 + np.exp(-sum(w[g] * v for g, v in x.items()))) - y
            for g, v in x.items():
                d = error * v
                old = n.get(g, 0.0)
                z[g] = z.get(g, 0.0) + d - ((old + d * d) ** 0.5 - old**0.5) / quality.ALPHA * w[g]
                n[g] = old + d * d
    return {d: 1 / (1 + np.exp(-dot(grams(t)))) for d, t in docs}


def test_quality_against_a_plain_twin(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARDS", 1)
    r = random.Random(17)
    docs = [(k, " ".join(words(r, 30) if k % 2 else [w + "!" for w in words(r, 30)])) for k in range(120)] + [(500, None), (501, ""), (502, "word word word")]
    labels = {k: k % 2 for k in range(120)}
    df = spark.createDataFrame([(d, t, "h") for d, t in docs], "doc_id long, text string, label string")
    lab = spark.createDataFrame([*labels.items(), (None, 1), (3, None), (7, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x["score"] for x in quality.scored(df, lab).collect()}
    want = brute_scores(docs, labels)
    assert max(abs(got[d] - want[d]) for d in want) < 0.02  # slots may be shared by two n-grams
    none = {x["score"] for x in quality.scored(df, lab.where("quality > 5")).collect()}
    assert none == {0.5}
    rows = df.select(quality.held_out(F.col("doc_id")).alias("h")).union(spark.createDataFrame([(None,)], "h long").select(quality.held_out(F.col("h")))).collect()
    assert all(x["h"] is not None for x in rows)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from lineup.llm.tokens import encoder, token_path

    r = random.Random(31)
    docs = [(d, t) for d, t in corpus() if t]
    docs += [(200 + k, " ".join(w + "$$$" for w in words(r, 60))) for k in range(60)]  # what the labels call bad
    docs += [(300 + k, " ".join(words(r, 70))) for k in range(60)]
    df = spark.createDataFrame([(d, t, "en", ["a", "b"][d % 2], len(t), 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([(d, int("$$$" not in t), 0) for d, t in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(names) == 4
    good = stages[0](spark, df, str(tmp_path))
    kept = {x["doc_id"]: x["text"] for x in good.collect()}
    score = {x["doc_id"]: x["own"] for x in quality.scored(df, spark.read.parquet(str(tmp_path / "labels.parquet")), name="own").collect()}
    assert good.columns == df.columns and set(kept) == {d for d, s in score.items() if s >= quality.KEEP}
    assert not any(200 <= d < 260 for d in kept) and sum(d >= 300 for d in kept) >= 50
    single = stages[1](spark, good, str(tmp_path))
    groups = brute_components(list(kept.items()))
    left = {x["doc_id"]: x["text"] for x in single.collect()}
    assert single.columns == df.columns and set(left) == {d for d, (_, c) in groups.items() if c == d}
    clean = stages[2](spark, single, str(tmp_path))
    want = brute_repeats(list(left.items()))
    got = clean.collect()
    assert clean.columns == df.columns and {x["doc_id"] for x in got} == set(left) and any(n for _, n, _ in want.values())
    for x in got:
        assert x["n_chars"] == len(x["text"]) and hashlib.sha256(b" ".join(x["text"].encode().split())).hexdigest() == want[x["doc_id"]][2]
    enc, at = encoder(token_path("word_bpe_49k.json")), {}
    for p in sorted(stages[3](spark, clean, str(tmp_path)).collect(), key=lambda p: p["start"]):
        at[p["doc_id"]] = at.get(p["doc_id"], b"") + bytes(p["ids"])
    assert {d: v for d, v in at.items()} == {x["doc_id"]: np.frombuffer(enc.encode(x["text"]), enc.dtype).astype("<u4").tobytes() + (2).to_bytes(4, "little") for x in got}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p["length"] for p in whole) == sum(len(v) // 4 for v in at.values())
    df.where("doc_id < 0").write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
