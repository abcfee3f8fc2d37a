"""Operator 12: frequent phrases by mergeable Misra-Gries summaries, counted exactly and scored as collocations.

Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; all is per language (null: ``und``).

First scans, a level at a time (single words; pairs; three to ``LONGEST`` words): every n-gram occurrence is a hash of its language and words, dealt to
a hash partition. A map task sums equal hashes and sends the sums of each partition as one packed row, so a hot phrase costs a task one entry; the partition's mass is
sent ahead. Each partition has a Misra-Gries summary whose capacity exceeds its mass divided by the threshold; rows are merged into it as they come: sums are
added, and where more entries are left than the capacity, the entry behind the last
that fits is subtracted from all. What is subtracted in all stays below the threshold, so no n-gram that is frequent can be lost; entries that can be frequent
(their count and what was subtracted reach the threshold) survive. An n-gram can only be frequent if its parts are: a level deals only those n-grams whose
words (pairs) have survived.

Survivors leave the summaries as bits of a Bloom filter, whose size follows their number and is bounded by ``MOST_BITS`` (32 MB); beyond, it lets more rare n-grams through to the
second pass, which costs rows there and changes no result. The second pass counts the surviving n-grams' texts themselves, so hashes decide nothing about counts.

Scores are whole numbers: decimals of 38 digits hold the products. A phrase is dropped if an extension by one word, left or right, is as frequent: any longer phrase
that is as frequent has one of these inside. The first rows of each language are found by a window that keeps that many rows of each task only.

Defined results: null and empty texts have no words; without frequent phrases there are no rows; repeated rows count as often as they stand there; ties as stated;
an empty table gives no rows; extra columns are not read. Texts are read in parts of whole words, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineup.llm.common import column, discard, documents, lower_ascii, materialize, mix64, signed, small_batches, utf8, values_of, word_hashes

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bits of the filter for each survivor, at least and at most so many in all (powers of two).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Hashes that a map task holds before it sends their sums, entries of a summary (mass of a partition / threshold), and hash partitions.
HELD, SUMMARY, PARTITIONS = 1 << 21, 1 << 16, (512, 1 << 16)
#: Phrases of a bucket of the second pass.
BUCKET = 20_000
#: Bytes of texts of one language that are taken together.
TOGETHER = 1 << 18
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BLANK = bytes(32 if _BREAK[b] else b for b in range(256))
_SPACE = _BREAK.copy()
_SPACE[[32, 9]] = True
#: About 256 KB that end with a whole word.
_PART = re.compile(rb"(?s).{1,262144}[^\x20\x09.,;:!?\x0A-\x0D]*")


def _mix_lang(lang: str | None) -> np.uint64:
    """A seed for the hashes of a language; equal seeds of two languages would only let more n-grams through to the second pass."""
    return mix64(word_hashes(re.sub(rb"\s", b"_", utf8(lang or "und"))) + np.uint64(77))[0]


def parts(data: bytes, longest: int = LONGEST):
    """A lower-cased text in parts: bytes with blanks for breaks, hashes of the words, the piece of each word, and how many words are carried over.

    A part begins with the last ``longest - 1`` words of the piece that the part before ended in; n-grams among them alone have been seen.
    """
    last = b""
    for m in _PART.finditer(data):
        data, carried = last + m.group(), last.count(b" ")
        raw = np.frombuffer(data, dtype=np.uint8)
        word = ~_SPACE[raw]
        start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        last = b""
        if len(start):
            blank, piece = data.translate(_BLANK), np.cumsum(_BREAK[raw])
            yield blank, word_hashes(blank), piece[start], carried
            open_ = start[piece[start] == piece[-1]][1 - longest :] if longest > 1 else start[:0]
            last = b"".join(w + b" " for w in blank[open_[0] :].split()) if len(open_) else b""


def _by_lang(batch: pa.RecordBatch):
    """``lang, text``: texts of one language of a batch, joined by breaks to ``TOGETHER`` bytes or more."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for lang, text in zip(column(batch, "lang").to_pylist(), values_of(batch, "text")):
        lang = "und" if lang is None else lang
        if text:
            held.setdefault(lang, []).append(lower_ascii(utf8(text)))
            size[lang] += len(text)
            if size[lang] > TOGETHER:
                yield lang, b"\n".join(held.pop(lang))
                del size[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


class Filter:
    """A Bloom filter of n-grams in ``bits``, an array of 64-bit words. An n-gram is known by its hash partition and 32 bits of its hash."""

    HASHES = 4

    def __init__(self, bits: np.ndarray, partitions: int, grams: int):
        self.bits, self.n, self.partitions, self.grams = bits, len(bits) * 64, partitions, grams

    @staticmethod
    def identity(hashes: np.ndarray, partitions: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(partitions)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)

    @classmethod
    def places(cls, grams: np.ndarray, n: int) -> list[np.ndarray]:
        one = mix64(grams)
        other = mix64(one + np.uint64(0x51ED27)) | np.uint64(1)
        return [((one + np.uint64(k) * other) & np.uint64(n - 1)).astype(np.int64) for k in range(cls.HASHES)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self.places(self.identity(hashes, self.partitions), self.n):
            found &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


class Grams:
    """The n-grams of a part that may be frequent: all words; pairs of surviving words; longer ones of surviving pairs."""

    def __init__(self, words: np.ndarray, piece: np.ndarray, carried: int, lang: np.uint64, single: Filter | None = None, pair: Filter | None = None):
        self.words, self.carried, self.lang, self.single, self.pair = words, carried, lang, single, pair
        self.same = piece[1:] == piece[:-1]

    def hashes(self, start: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(start), dtype=np.uint64)
        for j in range(n):
            total += self.words[start + j] * _FACTORS[j]
        return mix64(total) ^ self.lang

    def good_words(self) -> np.ndarray:
        if not hasattr(self, "_words"):
            every = np.arange(len(self.words))
            self._words = np.ones(len(every), dtype=bool) if self.single is None else self.single.holds(self.hashes(every, 1))
        return self._words

    def good_pairs(self) -> np.ndarray:
        if not hasattr(self, "_pairs"):
            good = self.good_words()
            self._pairs = self.same & good[1:] & good[:-1]
            if self.pair is not None:
                at = np.flatnonzero(self._pairs)
                self._pairs[at] = self.pair.holds(self.hashes(at, 2))
        return self._pairs

    def starts(self, n: int) -> np.ndarray:
        """Where the n-grams start; those that end among the carried words belong to the part before."""
        if n == 1:
            return np.arange(self.carried, len(self.words))
        count = len(self.words) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        if n == 2:
            good = self.good_words()
            fit = self.same & good[1:] & good[:-1]
        else:
            good = self.good_pairs()
            fit = good[:count].copy()
            for k in range(1, n - 1):
                fit &= good[k : k + count]
        fit[: max(0, self.carried - n + 1)] = False
        return np.flatnonzero(fit)


class MisraGries:
    """A mergeable summary: ``entries`` of at most ``capacity``; ``off`` bounds what any count has lost, below mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.off, self.mass = capacity, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts by distinct or repeated keys (another summary's entries, or plain sums)."""
        self.mass += int(counts.sum())
        every = np.concatenate([self.keys, keys])
        self.keys, at = np.unique(every, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            k = len(self.keys) - self.capacity - 1
            least = int(np.partition(self.counts, k)[k])
            self.off += least
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least

    def survivors(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.off >= threshold]


def summed_hashes(docs: DataFrame, orders: tuple[int, ...], partitions: int, single, pair) -> DataFrame:
    """``part, mass, keys, counts``: packed sums of a map task by hash partition, and a row without them that only tells the mass."""

    def run(batches):
        waiting, n = [], 0

        def sent():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            part = (keys >> np.uint64(32)).astype(np.int64)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            mass = np.add.reduceat(counts, edge[:-1]).tolist()
            low, counts = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), counts.astype("<u4")
            own, none = part[edge[:-1]].tolist(), [None] * len(spans)
            rows = [own * 2, mass * 2, none + [low[i:j].tobytes() for i, j in spans], none + [counts[i:j].tobytes() for i, j in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["part", "mass", "keys", "counts"])

        one, two = single and single.value, pair and pair.value
        for b in batches:
            for lang, text in _by_lang(b):
                seed = _mix_lang(lang)
                for _, words, piece, carried in parts(text, max(orders)):
                    grams = Grams(words, piece, carried, seed, one, two)
                    for k in orders:
                        found = grams.hashes(grams.starts(k), k)
                        waiting.append(Filter.identity(found, partitions))
                        n += len(found)
                    if n > HELD:
                        yield from sent()
                        waiting, n = [], 0
        if n:
            yield from sent()

    return docs.mapInArrow(run, "part long, mass long, keys binary, counts binary")


def survivors(sums: DataFrame, threshold: int) -> DataFrame:
    """``gram`` of every n-gram that can be frequent; a summary a hash partition, merged from the rows as they come behind the masses."""
    dealt = sums.repartition("part").sortWithinPartitions("part", F.col("keys").isNotNull())

    def run(batches):
        part, mass, summary = None, 0, None

        def left():
            grams = summary.survivors(threshold) | np.uint64(part) << np.uint64(32)
            return pa.RecordBatch.from_arrays([pa.array(signed(grams))], names=["gram"])

        for b in batches:
            rows = zip(column(b, "part").to_pylist(), column(b, "mass").to_pylist(), values_of(b, "keys"), values_of(b, "counts"))
            for own, more, keys, counts in rows:
                if own != part:
                    if summary is not None:
                        yield left()
                    part, mass, summary = own, 0, None
                if keys is None:
                    mass += more
                else:
                    summary = MisraGries(mass // threshold + 1) if summary is None else summary
                    summary.merge(np.frombuffer(keys, "<u4").astype(np.uint64), np.frombuffer(counts, "<u4").astype(np.int64))
        if summary is not None:
            yield left()

    return dealt.mapInArrow(run, "gram long")


def bloom(found: DataFrame, partitions: int) -> Filter:
    """The filter of a table of n-grams; tasks set bits, words are combined by OR, at most ``MOST_BITS`` bits come to the driver."""
    n = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length() if n else 0))

    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *Filter.places(column(b, "gram").to_numpy().view(np.uint64), bits)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = found.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Filter(out, partitions, n)


def exact_counts(docs: DataFrame, longest: int, least: int, single, pair, more) -> DataFrame:
    """``lang, words, phrase, f``: exact counts of the phrases that pass the filters and stand ``least`` times or more, by their text; a row of 0 words counts all words of a language.

    A task sends its counts packed, a row for each language and bucket of phrases, and buckets are added up as their rows come; a bucket holds about ``BUCKET`` phrases.
    """
    buckets = max(64, (single.value.grams + pair.value.grams + more.value.grams) // BUCKET)

    def run(batches):
        total: dict[str, Counter] = {}

        def sent():
            for lang, counter in total.items():
                dealt: dict[int, tuple[list, list]] = {}
                for phrase, n in counter.items():
                    own = dealt.setdefault(zlib.crc32(phrase) % buckets, ([], []))
                    own[0].append(phrase)
                    own[1].append(n)
                columns = [list(dealt), [lang] * len(dealt), [b"\n".join(p) for p, _ in dealt.values()], [np.array(n, "<u8").tobytes() for _, n in dealt.values()]]
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "lang", "phrases", "counts"])
            total.clear()

        one, two, rest = single.value, pair.value, more.value
        for b in batches:
            for lang, text in _by_lang(b):
                seed = _mix_lang(lang)
                counter = total.setdefault(lang, Counter())
                for data, words, piece, carried in parts(text, longest):
                    split = data.split()
                    grams = Grams(words, piece, carried, seed, one, two)
                    counter[b""] += len(split) - carried
                    counter.update(compress(split[carried:], grams.good_words()[carried:].tolist()))
                    for n in range(2, longest + 1):
                        start = grams.starts(n)
                        if n == 2:
                            start = start[grams.good_pairs()[start]]
                        else:
                            start = start[rest.holds(grams.hashes(start, n))]
                        counter.update([b" ".join(split[k : k + n]) for k in start.tolist()])
            if sum(map(len, total.values())) > 500_000:
                yield from sent()
        yield from sent()

    def summed(batches):
        own, counter = None, Counter()

        def left():
            kept = [(p, n) for p, n in counter.items() if n >= least or not p]
            columns = [[own[1]] * len(kept), [p.count(b" ") + 1 if p else 0 for p, _ in kept], [p.decode("utf-8", "surrogatepass") for p, _ in kept], [n for _, n in kept]]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "words", "phrase", "f"])

        for b in batches:
            for bucket, lang, phrases, counts in zip(*(values_of(b, c) for c in ("bucket", "lang", "phrases", "counts"))):
                if (bucket, lang) != own:
                    if own:
                        yield left()
                    own, counter = (bucket, lang), Counter()
                for p, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<u8").tolist()):
                    counter[p] += n
        if own:
            yield left()

    rows = docs.mapInArrow(run, "bucket long, lang string, phrases binary, counts binary")
    return rows.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(summed, "lang string, words long, phrase string, f long")


def frequent_phrases(df: DataFrame, longest: int = LONGEST, least: int = LEAST, partitions: int | None = None) -> DataFrame:
    """``lang, words, phrase, f`` of all phrases of 1 to ``longest`` (2 or more) words with ``least`` or more occurrences, as a written table.

    A row of 0 words holds a language's number of word occurrences.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    letters = docs.select(F.sum(F.length("text").cast("bigint")).alias("n")).first()["n"] or 0

    def level(orders, single=None, pair=None):
        # no more n-grams of a length than half of the characters: so many partitions that a summary stays small
        p = partitions or min(PARTITIONS[1], max(PARTITIONS[0], -(-len(orders) * letters // (2 * least * SUMMARY))))
        found = materialize(survivors(summed_hashes(docs, orders, p, single, pair), least), "phrases-survivors")
        out = spark.sparkContext.broadcast(bloom(found, p))  # at most MOST_BITS bits
        discard(found)
        return out

    single = level((1,))
    pair = level((2,), single)
    more = level(tuple(range(3, longest + 1)), single, pair) if longest > 2 else pair
    return materialize(exact_counts(docs, longest, least, single, pair, more), "phrases-counts")


def collocations(df: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, share: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases; ``share``: percent of a phrase's count at which an extension absorbs it."""
    counts = frequent_phrases(df, longest, least)
    totals = counts.where(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    counts = counts.where(F.col("words") > 0)
    words = F.split("phrase", " ")
    piece = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    # what an extension by one word says about the phrases inside it
    longer = counts.where(F.col("words") >= 3).select("lang", "f", F.explode(F.array(piece(F.lit(1), F.col("words").cast("int") - 1), piece(F.lit(2), F.col("words").cast("int") - 1))).alias("phrase"))
    absorbed = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = counts.where(F.col("words") >= 2).join(absorbed, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k"), F.col("words").cast("int").alias("words"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = counts.select(F.col("lang"), F.col("phrase").alias("part"), F.col("f"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals), "lang")  # a row a language
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    rows = lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return rows.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(documents(spark, sf_dir).select("lang", "text"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs),
grams AS (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
absorbed AS (SELECT DISTINCT p.lang, p.phrase FROM f p JOIN f q ON p.lang = q.lang AND q.k > p.k AND 100 * q.f >= 100 * p.f AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')),
kept AS (SELECT * FROM f WHERE k >= 2 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM absorbed)),
cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w, k FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, cut, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:c.k], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000
"""
