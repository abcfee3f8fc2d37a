"""Operator 3: near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Equal sets are one class, found by a digest of the set and aggregated before
anything else is shuffled. Classes meet in ``TREES`` independent random trees. The root of a tree sends a class to the node named by
its minwise token; a node of at most ``SMALL`` classes is compared exhaustively by sketches (four bits of each of
``COORDS`` minwise tokens). A larger node compares every class with its pivot, and its classes go down ``BRANCH``
paths of ``WIDTH`` minwise tokens that the node chooses; what is still large after ``DEPTH`` levels is compared block by block.

A node does not return its pairs but which of its classes hang together by pairs worth a look (sketches that agree in ``MAYBE`` or more):
one row for each class at most, so the output of a node does not grow with the square of its size, and the classes that
hang together with a pivot need no further comparison with each other. The connected components of these rows hold
every link. Then each component is resolved exactly: the texts of its classes meet once, every pair whose sketches agree is
compared on full shingle sets unless it is connected already, and the connected classes are returned, again a row for each. Components beyond
``CLASSES`` classes or ``SHINGLES`` shingles are dealt to blocks: classes meet inside their block and with a few pivots, and only those
that this leaves outside the component's main part visit the other blocks.

A pair at similarity 0.75 that meets nowhere (and has no common neighbour that would bring it to one component) is missed with probability
0.25^10 = 1e-6 in small nodes, and below 1e-3 where all ten of its roots are large.

Defined results: null and empty texts (no words) have an empty set, are linked with nothing and stand alone; fewer than five words are one
shingle; repeated rows are one class, and rows that share a doc_id keep their own sets; rows with a null doc_id stand alone, without a
component; the smallest doc_id of a group represents it; empty tables give no rows; extra columns are not read. Texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import _draws, column, discard, documents, fixed, materialize, mix64, shingle_set, signed, small_batches, values_of

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDS, TREES, BRANCH, WIDTH, SMALL, DEPTH, SAMPLE = 256, 10, 3, 3, 4096, 3, 48
BYTES = COORDS // 2
#: Estimated similarity from which a pair is worth a look: four deviations of the estimate below 0.75.
MAYBE = 0.63
#: Agreeing coordinates that this takes; unlike tokens agree in four bits once in sixteen.
AGREE = int(np.floor(COORDS * (MAYBE + (1 - MAYBE) / 16)))
#: Most classes and shingles of a component that one task resolves at once, and classes that all blocks of a larger one share.
CLASSES, SHINGLES, PIVOTS = 4096, 3_000_000, 16
#: Keys (16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_MUL, _ADD = (_draws(COORDS, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_draws(COORDS, 202) >> np.uint64(32)).astype(np.uint32)
_ONES = np.uint64(0x1111111111111111)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over the set; a hash is a bijection of 32-bit words."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024, None] * _MUL
        part += _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Four bits of each token, two tokens a byte."""
    four = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return four[::2] | four[1::2] << 4


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal coordinates of sketches (byte rows)."""
    x = np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= _ONES
    return COORDS - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: a hash of its text, set size, a 128-bit digest of the set, its sketch, and the root node of each tree."""
    text_ = F.col(text).cast("string")
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_).alias("th"), text_.alias("text"))

    def run(batches):
        salt = np.arange(TREES, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            size, one, two, sig, nodes = [], [], [], [], []
            for t in values_of(b, "text"):
                s = shingle_set(t, WORDS)
                size.append(len(s))
                if not len(s):
                    one.append(0), two.append(0), sig.append(b""), nodes.append([])
                    continue
                one.append(int(signed(np.add.reduce(mix64(s))[None])[0]))
                two.append(int(signed(np.bitwise_xor.reduce(mix64(s + np.uint64(77)))[None])[0]))
                m = minwise(s)
                sig.append(sketch(m).tobytes())
                nodes.append(signed(mix64(m[:TREES].astype(np.uint64) + salt)).tolist())
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "th"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n", "d1", "d2", "sig", "nodes"],
            )

    return src.mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long, sig binary, nodes array<long>")


def spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` items reaches over the pairs ``a, b``."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _groups(batches, keys: list[str], names: list[str]):
    """Lists of columns (arrays) of runs of whole groups; the rows come sorted by ``keys``. A run ends with its group, after 65,536 rows or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and b.num_rows and sum(h.num_rows for h in held) >= 65_536:
            same = np.ones(b.num_rows, dtype=bool)
            for k in keys:
                same &= column(b, k).to_numpy() == column(held[-1], k)[-1].as_py()
            more = int(same.sum())  # the rows are sorted, so these are the first ones
            held.append(b.slice(0, more))
            if more < b.num_rows:
                yield pa.Table.from_batches(held).select(names).combine_chunks()
                held = []
            b = b.slice(more)
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).select(names).combine_chunks()


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _hang_together(sigs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least index that each class of a node reaches over pairs worth a look; classes of one group (0: none) hang together already."""
    n = len(sigs)
    label = np.full(n, -1)
    order = np.argsort(group, kind="stable")
    first = {}
    for k in order[np.searchsorted(group[order], 1) :].tolist():
        first.setdefault(int(group[k]), []).append(k)
    left = np.arange(n)
    while len(left):
        seed = int(left[0])
        wave, left = [seed], left[1:]
        label[seed] = seed
        while wave:
            k = wave.pop()
            if group[k] and (mates := first.pop(int(group[k]), None)):
                fresh = [m for m in mates if label[m] < 0]
                label[fresh] = seed
                wave += fresh
                left = left[label[left] < 0]
            if not len(left):
                break
            near = agreement(sigs[left], sigs[k][None]) >= AGREE
            if near.any():
                found = left[near]
                label[found] = seed
                wave += found.tolist()
                left = left[~near]
    return label


def compare_nodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``x, y``: classes of a (bounded) node and a smaller class of it that they hang together with. ``rows``: keys, cid, sig, grp."""
    rows = rows.select(*keys, "cid", "sig", F.coalesce("grp", F.lit(0)).alias("grp")).repartition(*keys).sortWithinPartitions(*keys, "cid")

    def run(batches):
        for t in _groups(batches, keys, [*keys, "cid", "sig", "grp"]):
            cid, grp = t["cid"].to_numpy(), t["grp"].to_numpy()
            edge = _bounds(*(t[k].to_numpy() for k in keys))
            sigs = fixed(t["sig"], BYTES)
            size = np.diff(edge)
            x, y = [], []
            for k in np.flatnonzero(size > 64).tolist():
                part = slice(edge[k], edge[k + 1])
                label = _hang_together(sigs[part], grp[part])
                own = np.flatnonzero(label != np.arange(len(label)))
                x.append(cid[part][own]), y.append(cid[part][label[own]])
            # the pairs of many small nodes at once
            few = (size > 1) & (size <= 64)
            at, n = edge[:-1][few], size[few]
            ends = np.cumsum(n * (n - 1) // 2)
            a, b = [], []
            begin = 0
            while begin < len(n):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 40_000)))
                i, j = _pairs(at[begin:stop], n[begin:stop])
                near = (agreement(sigs[i], sigs[j]) >= AGREE) | ((grp[i] == grp[j]) & (grp[i] > 0))
                a.append(i[near]), b.append(j[near])
                begin = stop
            if a:
                label = spread(len(cid), np.concatenate(a), np.concatenate(b))
                own = np.flatnonzero(label != np.arange(len(label)))
                x.append(cid[own]), y.append(cid[label[own]])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)), pa.array(np.concatenate(y or none))], names=["x", "y"])

    return rows.mapInArrow(run, "x long, y long")


def _pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places inside each run."""
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = np.repeat(start, size) + place
    i = np.repeat(own, place)
    j = np.repeat(np.repeat(start, size), place) + (np.arange(place.sum()) - np.repeat(np.cumsum(place) - place, place))
    return i, j


def _branch(batches):
    """Whether a class of a large node is worth a look beside the pivot, and its child nodes."""
    for b in batches:
        node = column(b, "node").to_numpy().astype(np.int64).view(np.uint64)
        n = len(node)
        if not n:
            continue
        own = fixed(column(b, "sig"), BYTES)
        near = agreement(own, fixed(column(b, "pivot_sig"), BYTES)) >= AGREE
        children = []
        for j in range(BRANCH):
            path = mix64(node + np.uint64(j + 1))
            child = path
            for k in range(WIDTH):
                at = (mix64(path + np.uint64(k)) % np.uint64(COORDS)).astype(np.int64)
                token = own[np.arange(n), at >> 1] >> ((at & 1) * 4).astype(np.uint8) & np.uint8(15)
                child = mix64(child + token)
            children.append(signed(child))
        yield pa.RecordBatch.from_arrays(
            [*(column(b, c) for c in ("node", "cid", "sig", "grp", "pivot")), pa.array(near), pa.array(np.stack(children, axis=1).tolist(), pa.list_(pa.int64()))],
            names=["node", "cid", "sig", "grp", "pivot", "near", "children"],
        )


def _medoid(batches):
    """The pivot of each large node: the sampled class that is worth a look beside most others without a group."""
    for b in batches:
        out = [[], [], []]
        for node, rows in zip(values_of(b, "node"), values_of(b, "rows"), strict=True):
            rows = sorted(rows, key=lambda r: (r["grp"] is not None, r["cid"]))[: 4 * SAMPLE]
            own = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint8).reshape(len(rows), BYTES)
            free = [k for k, r in enumerate(rows) if r["grp"] is None] or list(range(len(rows)))
            near = [int((agreement(own[free], own[k][None]) >= AGREE).sum()) for k in free]
            best = rows[free[int(np.argmax(near))]]
            for c, v in zip(out, (node, best["cid"], best["sig"]), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["node", "pivot", "pivot_sig"])


def candidates(classes: DataFrame) -> DataFrame:
    """``x, y``: classes that hang together in some node. ``classes``: cid, sig, nodes."""
    sigs = classes.select("cid", "sig")
    rows = classes.select(F.explode("nodes").alias("node"), "cid", F.lit(None).cast("long").alias("grp"))
    found, scratch = [], []

    def keep(df, name):
        scratch.append(materialize(df, name))
        return scratch[-1]

    for level in range(DEPTH + 1):
        stats = rows.groupBy("node").agg(F.count("*").alias("size"), F.count("grp").alias("grouped"), F.min("grp").alias("g1"), F.max("grp").alias("g2"))
        # a node needs work if it has two classes that are not in one group
        stats = stats.where((F.col("size") > 1) & ((F.col("grouped") < F.col("size")) | (F.col("g1") != F.col("g2")))).select("node", "size")
        stats = keep(stats, "neardup-nodes")
        alone = stats.where(F.col("size") > SMALL).isEmpty()
        live = rows.join(stats, "node") if level else rows.join(stats, "node").join(sigs, "cid")
        live = live if alone else keep(live, "neardup-live")
        found.append(keep(compare_nodes(live if alone else live.where(F.col("size") <= SMALL), ["node"]), "neardup-hang"))
        if alone:
            break
        large = live.where(F.col("size") > SMALL)
        if level == DEPTH:
            blocks = F.ceil(F.col("size") / SMALL)
            part = large.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
            part = part.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
            part = part.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
            found.append(keep(compare_nodes(part, ["node", "b1", "b2"]), "neardup-hang"))
            break
        # a sample picks the pivot only
        few = large.where(F.pmod(F.xxhash64("cid", "node"), F.col("size")) < SAMPLE)
        pivots = few.groupBy("node").agg(F.collect_list(F.struct("cid", "sig", "grp")).alias("rows")).mapInArrow(_medoid, "node long, pivot long, pivot_sig binary")
        pivots = keep(pivots, "neardup-pivots")
        next_ = large.join(pivots, "node").select("node", "cid", "sig", "grp", "pivot", "pivot_sig")
        next_ = keep(next_.mapInArrow(_branch, "node long, cid long, sig binary, grp long, pivot long, near boolean, children array<long>"), "neardup-branch")
        found.append(next_.where(F.col("near") & (F.col("cid") != F.col("pivot"))).select(F.greatest("cid", "pivot").alias("x"), F.least("cid", "pivot").alias("y")))
        rows = next_.select(F.explode("children").alias("node"), "cid", "sig", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("grp")).alias("grp"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = materialize(pairs.distinct(), "neardup-candidates")
    discard(*scratch)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """``cid, component`` (smallest reachable id) of all ends of the links ``x, y``: label propagation with pointer jumping."""
    edges = materialize(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "neardup-edges")
    labels = materialize(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "neardup-labels")
    while True:
        other = labels.select(F.col("x").alias("y"), F.col("label").alias("other"))
        best = edges.join(other, "y").groupBy("x").agg(F.min("other").alias("near"))
        step = labels.join(best, "x").select("x", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("x").alias("new"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "new").select("x", F.least("new", "far").alias("label"), (F.col("label") != F.least("new", "far")).alias("moved")), "neardup-step")
        done = step.where("moved").isEmpty()
        discard(labels)
        labels = step
        if done:
            discard(edges)
            return labels.select(F.col("x").alias("cid"), F.col("label").alias("component"))


class Sets:
    """Full shingle sets of the classes of a block, as runs of word numbers, for exact intersections of one class with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        every, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code = self.code.astype(np.int32)
        self.mark = np.zeros(len(every), dtype=np.uint8)

    def linked(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked with ``k``."""
        own = self.code[self.at[k] : self.at[k + 1]]
        self.mark[own] = 1
        out = np.zeros(len(others), dtype=bool)
        begin = 0
        while begin < len(others):  # about a million words at a time
            size = np.cumsum(self.size[others[begin:]])
            stop = begin + max(1, int(np.searchsorted(size, 1_000_000)))
            part = others[begin:stop]
            n = self.size[part]
            before = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(self.at[part] - before, n)
            both = np.add.reduceat(self.mark[self.code[place]], before, dtype=np.int64)
            out[begin:stop] = 100 * both >= PERCENT * (self.size[k] + n - both)
            begin = stop
        self.mark[own] = 0
        return out

    def near(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those whose sizes allow a link with ``k``."""
        a, b = self.size[k], self.size[others]
        return others[100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)]


def resolve(sets: list[np.ndarray], sigs: np.ndarray, known: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The least index that each class of a block reaches over links. Classes with one value in ``known`` are connected already;
    two classes are compared unless both are visitors (``home`` false)."""
    n = len(sets)
    s = Sets(sets)
    label, left = np.full(n, -1), np.arange(n)
    mates: dict[int, list[int]] = {}
    for k, v in enumerate(known.tolist()):
        mates.setdefault(v, []).append(k)
    while len(left):
        seed = int(left[0])
        wave = [k for k in mates.pop(int(known[seed]), [])]
        label[wave] = seed
        left = left[label[left] < 0]
        while wave and len(left):
            k = wave.pop()
            some = s.near(k, left if home[k] else left[home[left]])
            if len(some) > 8:
                some = some[agreement(sigs[some], sigs[k][None]) >= AGREE]
            if len(some) and (hit := s.linked(k, some)).any():
                for v in np.unique(known[some[hit]]).tolist():
                    fresh = mates.pop(v, [])
                    label[fresh] = seed
                    wave += fresh
                left = left[label[left] < 0]
    return spread(n, np.arange(n), label)


def resolve_blocks(rows: DataFrame) -> DataFrame:
    """``comp, x, y``: each class of a block and the smallest class that it is connected with there. ``rows``: comp, block, cid, sig, text, known, home."""
    keys = ["comp", "block"]
    rows = rows.select(*keys, "cid", "sig", "text", "known", "home").repartition(*keys).sortWithinPartitions(*keys, "cid")

    def flush(rows_):
        rows_ = [r for k, r in enumerate(rows_) if not k or r[0] != rows_[k - 1][0]]  # rows that share doc_id and text are one class
        if len(rows_) < 2:
            return rows_, np.zeros(len(rows_), dtype=np.int64)
        sigs = np.frombuffer(b"".join(r[1] for r in rows_), dtype=np.uint8).reshape(len(rows_), BYTES)
        return rows_, resolve([r[2] for r in rows_], sigs, np.array([r[3] for r in rows_]), np.array([r[4] for r in rows_]))

    def run(batches):
        last, held, out = None, [], [[], [], []]

        def end():
            rows_, label = flush(held)
            for r, m in zip(rows_, label.tolist(), strict=True):
                for c, v in zip(out, (last[0], r[0], rows_[m][0]), strict=True):
                    c.append(v)

        for b in batches:
            for comp, block, cid, sig, text, known, home in zip(*(values_of(b, c) for c in ("comp", "block", "cid", "sig", "text", "known", "home")), strict=True):
                if (comp, block) != last:
                    if held:
                        end()
                    last, held = (comp, block), []
                held.append((cid, sig, shingle_set(text, WORDS), known, home))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["comp", "x", "y"])
            out = [[], [], []]
        if held:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["comp", "x", "y"])

    return rows.mapInArrow(run, "comp long, x long, y long")


def links(docs: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """``cid, root``: the connected classes of each candidate component (``cid, component``), resolved on full sets."""
    members = classes.join(comps, "cid").select("cid", "doc_id", "th", "n", "sig", F.col("component").alias("comp"))
    size = members.groupBy("comp").agg(F.count("*").alias("classes"), F.ceil(F.greatest(F.count("*") / CLASSES, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    members = materialize(members.join(size, "comp"), "neardup-members")
    keys = members.select("doc_id", "th")
    texts = docs
    if members.count() <= BROADCAST_ROWS:  # the texts that are asked for are picked before the shuffle
        texts = texts.join(F.broadcast(keys), ["doc_id", "th"], "left_semi")
    rows = texts.join(members.drop("n"), ["doc_id", "th"])
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    first = rows.select("comp", block.alias("block"), "cid", "sig", "text", F.col("cid").alias("known"), F.lit(True).alias("home"))
    many = not members.where("blocks > 1").isEmpty()
    if not many:
        return materialize(resolve_blocks(first), "neardup-links").select(F.col("x").alias("cid"), F.col("y").alias("root"))
    shared = rows.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("cid", F.lit(7)), F.col("classes")) < PIVOTS))
    shared = shared.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cid", "sig", "text", F.col("cid").alias("known"), F.lit(True).alias("home"), block.alias("own")).where("block <> own").drop("own")
    inside = materialize(resolve_blocks(first.unionByName(shared)), "neardup-inside")
    large = members.where("blocks > 1").select("cid", "comp", "blocks")
    labels = materialize(components(inside.join(large.select("comp").distinct(), "comp").select("x", "y")).join(large, "cid"), "neardup-parts")
    main = labels.groupBy("comp", "component").count().groupBy("comp").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    parts = labels.join(main, "comp").select("cid", "component", (F.col("component") != F.col("main")).alias("visits"))
    placed = rows.where("blocks > 1").join(materialize(parts, "neardup-visits"), "cid").select("comp", block.alias("block"), "blocks", "cid", "sig", "text", F.col("component").alias("known"), "visits")
    visitors = placed.where("visits").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    second = placed.select("comp", "block", "cid", "sig", "text", "known", F.lit(True).alias("home")).unionByName(visitors.select("comp", F.col("other").alias("block"), "cid", "sig", "text", "known", F.lit(False).alias("home")))
    between = resolve_blocks(second)
    every = materialize(inside.select("x", "y").unionByName(between.select("x", "y")).distinct(), "neardup-links")
    return components(every).select("cid", F.col("component").alias("root"))


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, th`` (hash of the text), ``n_shingles, component_id, kept``."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sigs = materialize(signatures(docs), "neardup-sets")
    usable = sigs.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    # the ids are read from the written table only, so a repeated task cannot change them
    classes = materialize(classes.select((F.monotonically_increasing_id() + 1).alias("cid"), "d1", "d2", "n", "rep.doc_id", "rep.th", "sig", "nodes"), "neardup-classes")
    pairs = candidates(classes)
    comps = components(pairs)
    found = links(docs.withColumn("th", F.xxhash64("text")), classes, comps)
    ids = classes.select("cid", "doc_id")
    least = found.join(ids, "cid").groupBy("root").agg(F.min("doc_id").alias("component"))
    named = classes.join(found, "cid", "left").join(least, "root", "left").select("d1", "d2", "n", F.coalesce("component", "doc_id").alias("component"))
    named = materialize(named, "neardup-named")
    out = sigs.select("doc_id", "th", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    return grouped(df, doc_id, text).drop("th")


def query(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def stage(spark, docs, sf_dir):
    """Pipeline stage: one document of each group stays, with all its columns."""
    gone = materialize(grouped(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_hash")), "neardup-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
