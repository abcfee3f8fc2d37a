"""The similarity join by signatures against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lineup.operators import identity, similar

FIRST = "james john mary anna luka tj dwayne christopher alexander bob li maximilian".split()
LAST = "smith smyth johnson jonson lee li anderson andersen montgomery villanueva o brown browne".split()


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one(how, a, b):
    if how == "edits":
        return 1 - lev(a, b) / max(len(a), len(b), 1)
    return difflib.SequenceMatcher(None, a, b).ratio()


def spoiled(r, s):
    s = list(s)
    for _ in range(r.randrange(4)):
        k, at = r.randrange(3), r.randrange(len(s) + 1)
        if k == 0:
            s.insert(at, r.choice("aeio xq"))
        elif s and k == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = r.choice("bdkz")
    return " ".join("".join(s).split())


@pytest.fixture(scope="module")
def people():
    r = random.Random(4)
    members = sorted({f"{r.choice(FIRST)} {r.choice(LAST)}{r.choice(['', 'son', 'ez', 'ski'])}" for _ in range(150)})
    names = sorted({spoiled(r, r.choice(members)) for _ in range(150)} | {"", "a", "ab"})
    return names, members


def frames(spark, people):
    names, members = people
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(m,) for m in members], "member_name string")


@pytest.mark.parametrize("how", ["edits", "sequence"])
@pytest.mark.parametrize("least", [0.75, 0.9])
def test_no_pair_is_lost(spark, people, how, least):
    names, members = people
    a, b = frames(spark, people)
    got = {(x["name"], x["member_name"]): x["score"] for x in similar.similar_pairs(a, b, [], least, how).collect()}
    want = {(n, m): one(how, n, m) for n in names for m in members}
    want = {k: v for k, v in want.items() if v >= least - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("least", [0.75, 0.85])
def test_no_token_pair_is_lost(spark, people, least):
    a, b = frames(spark, people)
    every = a.crossJoin(b).withColumn("score", similar.tokenwise_ratio(F.col("name"), F.col("member_name"))).where(F.col("score") >= least)
    got = similar.similar_pairs(a, b, [], least, tokens=True)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in every.collect()}


def test_blocks_large_and_small_give_the_same(spark, people):
    a, b = frames(spark, people)
    a, b = (x.withColumn("block", F.pmod(F.xxhash64(x.columns[0]), F.lit(2))) for x in (a, b))
    whole = similar.similar_pairs(a, b, ["block"], 0.75, direct=10**6)
    signed = similar.similar_pairs(a, b, ["block"], 0.75, direct=0)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in signed.collect()}


def test_few_candidates_in_one_block(spark):
    """8,000 names of four syllables on each side, a third of them with one ending: 6.4e7 pairs, of which a twentieth is compared at most."""
    syllable = F.array(*[F.lit(c + v + e) for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r")])
    part = lambda seed: F.get(syllable, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(180)).cast("int"))
    of = lambda seed: F.concat(part(seed), part(seed + 1), F.lit(" "), part(seed + 2), part(seed + 3), F.when(F.col("id") % 3 == 0, "son").otherwise(""))
    a = spark.range(8_000).select(F.lit(1).alias("block"), of(1).alias("name"))
    b = spark.range(8_000).select(F.lit(1).alias("block"), of(11).alias("member_name"))
    n = similar.candidates(a, b, ["block"], 0.75).count()
    assert n < 6.4e7 / 20


def test_misspelt_initials_are_found_over_all_schools(spark):
    roster = spark.createDataFrame([(1, "christopher montgomery", 1), (2, "anna lee", 1), (3, "bob smith", 2), (4, "bob smith", 3)], "member long, member_name string, school int")
    rows = spark.createDataFrame([(1, "khristopher montgomery", 9), (2, "christopher nontgomery", 8), (3, "bob smith", 7), (4, "anna lee", 6)], "name_id long, name string, school int")
    got = {r["name_id"]: (r["member"], r["tier"]) for r in identity.resolve_identities(rows, roster, ["school"], []).collect()}
    assert got == {1: (1, 4), 2: (None, None), 3: (None, None), 4: (2, 3)}  # 2 comes after 1 and the id is claimed once


def test_equal_names_tie_and_copies_do_not_multiply(spark):
    roster = spark.createDataFrame([(k, "anna lee", "PG", 1) for k in range(500)] + [(900, "anna leo", "C", 1)], "member long, member_name string, member_position string, school int")
    names = spark.createDataFrame([(k, "anna lee", "C", 1) for k in range(500)], "name_id long, name string, position string, school int")
    got = identity.match_names(names, roster, ["school"])
    assert {(r["member"], r["status"]) for r in got.collect()} == {(900, "matched")}
    assert similar.candidates(names, roster, ["school"], 0.75).count() <= 4


def test_pairs_are_never_broadcast(spark):
    """Rows of signatures compress so well that a side below the limit of a broadcast has filled the driver."""
    names = spark.createDataFrame([(1, f"anna nr{i}son") for i in range(30)], "school int, name string")
    members = names.withColumnRenamed("name", "member_name")
    for tokens, how in ((False, "edits"), (True, "edits"), (False, "sequence")):
        plan = similar.candidates(names.drop("school"), members.drop("school"), [], 0.75, how, tokens)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
