"""Similarity join of strings: equal signatures in place of all pairs of a block.

A pair can only reach a similarity if few operations turn one string into the other (``budget``): edits for the edit ratio, single insertions and deletions for the
sequence matcher's. With ``k`` operations, one of ``k + 1`` equal pieces of the member's string stands unchanged in the name, and not far from its place: the
``i``-th piece moves by ``i`` at most on account of the operations before it, and by ``k - i`` as counted from the end. Each side gives a hash for each pair of
lengths, piece and place, the join is on (block, hash), and the similarity decides. Nothing that reaches it is lost; a hash that meets by
chance costs a comparison. A hash that many members have (a common ending) is refined: what is left of both strings without that piece is within the same
operations, so one of its pieces stands unchanged, too, and is hashed beside the first. Blocks of few members are compared whole, which takes fewer rows than
their signatures.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from lineup.functions.scalars import first_last, levenshtein_ratio

#: Distinct members of a block that are compared without signatures (a name has some hundred signatures, each of which costs more than a comparison), and
#: operations of a first name up to which its pieces are signed, too.
DIRECT, SIGNED = 1000, 1
#: Parts of a whole block's names, so that one block's comparisons are several tasks.
SLICES = 8
#: Members of a hash from which it is refined, and how often.
HOT, REFINED = 50, 1
_EPS = 1e-9


def _blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity by matching blocks, as Python's sequence matcher has it; NULL beside NULL."""
    return F.pandas_udf(_blocks_ratio, DoubleType())(a, b)


def ratio(how: str, a: Column, b: Column) -> Column:
    if how not in ("edits", "sequence"):
        raise ValueError("how is edits or sequence")
    return levenshtein_ratio(a, b) if how == "edits" else sequence_ratio(a, b)


def partners(n: Column, least: float, how: str) -> Column:
    """The lengths that a string may have beside one of length ``n``, as an array."""
    factor = least if how == "edits" else least / (2 - least)
    return F.sequence(F.ceil(n * factor - _EPS).cast("int"), F.floor(n / factor + _EPS).cast("int"))


def budget(a: Column, b: Column, least: float, how: str) -> Column:
    """Operations between strings of these lengths that the similarity allows at most."""
    return F.floor((1 - least) * (F.greatest(a, b) if how == "edits" else a + b) + _EPS).cast("int")


def letters(x: Column) -> Column:
    """The letters of a string, each with how often it has stood before: equal elements of two strings count their common letters."""
    return F.transform(F.array(F.split(x, "")), lambda s: F.transform(s, lambda c, i: F.concat(c, F.size(F.filter(F.slice(s, 1, i), lambda y: y == c)).cast("string"))))[0]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(own: Column, a: Column, b: Column, k: Column, member: bool) -> Column:
    """Pieces of a member's string (its length is ``b``), or what a name (``a``) may have in their places, for ``k`` operations: structs of a hash of the piece's number and text, the string without it, and the lengths and operations left."""
    start = lambda i: F.floor(i * b / (k + 1)).cast("int")

    def piece(i: Column, at: Column, size: Column) -> Column:
        rest = F.concat(F.substring(own, F.lit(1), at), F.substring(own, at + size + 1, F.length(own)))
        return F.struct(F.xxhash64(i, F.substring(own, at + 1, size)).alias("key"), rest.alias("rest"), (a - size).alias("a"), (b - size).alias("b"), k.alias("k"))

    def placed(i: Column) -> Column:
        p, size = start(i), start(i + 1) - start(i)
        if member:
            return F.array(piece(i, p, size))
        low = F.greatest(p - i, p + a - b - (k - i), F.lit(0))
        high = F.least(p + i, p + a - b + (k - i), a - size)
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(a, F.lit(0))), lambda q: (q >= low) & (q <= high)), lambda q: piece(i, q, size))

    # more pieces than letters: such short strings meet all of their lengths
    none = F.array(F.struct(F.xxhash64(F.lit(-1)).alias("key"), own.alias("rest"), a.alias("a"), b.alias("b"), k.alias("k")))
    return F.when((k >= b) & (b > 0), none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), k), placed)))


def _lengths(own: Column, member: bool, least: float, how: str, body) -> Column:
    """``body(a, b, k)`` for every length that the other side may have, flattened."""

    def each(n: Column) -> Column:
        return F.flatten(F.transform(partners(n, least, how), lambda m: _let(budget(n, m, least, how), lambda k: body(m, n, k) if member else body(n, m, k))))

    return _let(F.length(own), each)


def signatures(x: Column, member: bool, least: float, how: str = "edits") -> Column:
    """Structs with a ``key`` of which two strings of this similarity share one at least, and what ``refined`` needs."""
    keyed = lambda a, b, k: F.transform(_pieces(x, a, b, k, member), lambda p: p.withField("key", F.xxhash64(a, b, p["key"])))
    return F.array_distinct(_lengths(x, member, least, how, keyed))


def token_signatures(first: Column, last: Column, member: bool, least: float, how: str = "edits") -> Column:
    """Hashes of which two strings share one if their first and their last tokens both have the similarity: signatures of the last tokens beside lengths and, with few operations, pieces of the first."""
    none = F.array(F.lit(0).cast("bigint"))
    keys = lambda own, a, b, k: F.transform(_pieces(own, a, b, k, member), lambda p: p["key"])
    firsts = _lengths(first, member, least, how, lambda a, b, k: F.transform(F.when(k <= SIGNED, keys(first, a, b, k)).otherwise(none), lambda h: F.xxhash64(a, b, h)))
    lasts = F.array_distinct(F.transform(signatures(last, member, least, how), lambda p: p["key"]))
    return F.array_distinct(_let(lasts, lambda ends: F.flatten(F.transform(F.array_distinct(firsts), lambda f: F.transform(ends, lambda e: F.xxhash64(f, e))))))


def _refined(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the hashes that more than ``HOT`` members have refined by a piece of what is left."""
    hot = b.where(F.col("p.k").isNotNull()).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*on, F.lit(True).alias("_hot"))

    def side(df: DataFrame, member: bool) -> DataFrame:
        more = F.transform(_pieces(F.col("p.rest"), F.col("p.a"), F.col("p.b"), F.col("p.k"), member), lambda q: q.withField("key", F.xxhash64(F.col("_key"), q["key"])))
        same = F.array(F.col("p"))
        found = df.join(hot.hint("merge"), on, "left").withColumn("p", F.explode(F.when(F.col("_hot"), F.array_distinct(more)).otherwise(same)))
        return found.withColumn("_key", F.col("p.key")).drop("_hot")

    return side(a, False), side(b, True)


def _side(df: DataFrame, block: list[str], c: str, tokens: bool) -> DataFrame:
    """Distinct strings of one side; what each pair of it needs (tokens, letters) is made once a string, in as many tasks as shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.select(*block, c).where(F.col(c).isNotNull()).distinct().repartition(n, c)
    if tokens:
        first, last = first_last(F.col(c))
        out = out.withColumns({f"_first_{c}": first, f"_last_{c}": last})
    return out


def block_pairs(names: DataFrame, members: DataFrame, block: list[str]) -> DataFrame:
    """All pairs of a block, in ``SLICES`` tasks or more a block: its names are dealt, its members copied to each."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint")))
    left = names.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(SLICES))).repartition(n, *block, "_part")
    return left.join(members.withColumn("_part", every).repartition(n, *block, "_part").hint("merge"), [*block, "_part"]).drop("_part")


def _candidates(names: DataFrame, members: DataFrame, block: list[str], least: float, how: str, tokens: bool, direct: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of distinct strings that share a signature (a pair may stand several times), and all pairs of the blocks with few members, each once."""
    a, b = _side(names, block, "name", tokens), _side(members, block, "member_name", tokens)
    on = [*block, "_key"]
    if how == "sequence" and not tokens:
        a, b = a.withColumn("_letters", letters(F.col("name"))), b.withColumn("_other", letters(F.col("member_name")))
    whole = None
    if block:
        large = b.groupBy(*block).agg((F.count("*") > direct).alias("_large"))
        own, other = a.join(large, block), b.join(large, block)
        whole = block_pairs(own.where("NOT _large").drop("_large"), other.where("NOT _large").drop("_large"), block)
        a, b = own.where("_large").drop("_large"), other.where("_large").drop("_large")

    def exploded(df: DataFrame, c: str, member: bool) -> DataFrame:
        if tokens:
            return df.withColumn("_key", F.explode(token_signatures(F.col(f"_first_{c}"), F.col(f"_last_{c}"), member, least, how)))
        return df.withColumn("p", F.explode(signatures(F.col(c), member, least, how))).withColumn("_key", F.col("p.key"))

    a, b = exploded(a, "name", False), exploded(b, "member_name", True)
    if not tokens:
        for _ in range(REFINED):
            a, b = _refined(a, b, on)
        a, b = a.drop("p"), b.drop("p")
    # equal endings make rows of signatures compress tenfold and more, so that a side that looks small enough to broadcast is not small in the driver
    return a.join(b.hint("merge"), on).drop("_key"), whole


def candidates(names: DataFrame, members: DataFrame, block: list[str], least: float, how: str = "edits", tokens: bool = False, direct: int = DIRECT) -> DataFrame:
    """``*block, name, member_name`` (and their tokens): the pairs that ``similar_pairs`` looks at; a pair may stand several times."""
    signed, whole = _candidates(names, members, block, least, how, tokens, direct)
    return signed if whole is None else signed.unionByName(whole)


def tokenwise_ratio(a: Column, b: Column, how: str = "edits") -> Column:
    """The smaller of the first names' and the last names' similarity."""
    (f1, l1), (f2, l2) = first_last(a), first_last(b)
    return F.least(ratio(how, f1, f2), ratio(how, l1, l2))


def _possible(a: Column, b: Column, least: float, how: str) -> Column:
    """Whether the lengths allow the similarity."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return short >= least * long - _EPS if how == "edits" else 2 * short >= least * (short + long) - _EPS


def similar_pairs(names: DataFrame, members: DataFrame, block: list[str], least: float, how: str = "edits", tokens: bool = False, direct: int = DIRECT) -> DataFrame:
    """``*block, name, member_name, score`` of all pairs of distinct strings of a block with a similarity of ``least`` or more."""
    if tokens:
        sides = [(F.col("_first_name"), F.col("_first_member_name")), (F.col("_last_name"), F.col("_last_member_name"))]
    else:
        sides = [(F.col("name"), F.col("member_name"))]

    def scored(pairs: DataFrame, once: bool) -> DataFrame:
        for x, y in sides:
            pairs = pairs.where(_possible(x, y, least, how))
            if how == "edits":  # a distance that stops at the most edits costs a third of a full one
                pairs = pairs.where(F.call_function("levenshtein", x, y, budget(F.length(x), F.length(y), least, how)) >= 0)
        if how == "sequence":  # an upper bound inside the JVM, and each pair once, before the worker sees it
            if not tokens:
                pairs = pairs.where(2 * F.size(F.array_intersect("_letters", "_other")) >= least * (F.length("name") + F.length("member_name")) - _EPS).drop("_letters", "_other")
            pairs = pairs if once else pairs.distinct()
        score = F.least(*[ratio(how, x, y) for x, y in sides]) if tokens else ratio(how, *sides[0])
        pairs = pairs.withColumn("score", score).where(F.col("score") >= least - _EPS).select(*block, "name", "member_name", "score")
        return pairs if once or how == "sequence" else pairs.distinct()

    signed, whole = _candidates(names, members, block, least, how, tokens, direct)
    return scored(signed, False) if whole is None else scored(signed, False).unionByName(scored(whole, True))


def smallest(members: DataFrame, by: list[str], member: str, n: int) -> DataFrame:
    """The ``n`` smallest members of each group of equal names; more never take part in a decision."""
    w = Window.partitionBy(*by).orderBy(member)
    return members.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
