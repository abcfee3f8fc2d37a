"""Counterfactual rosters by running sums against rosters that are built member by member."""

import numpy as np
from lineup.operators import rosters


def tables(spark):
    rng = np.random.default_rng(6)
    members = []
    for school in range(12):
        for m in range(int(rng.integers(1, 14)) if school else 0):
            pct = float(rng.choice([0.0, 5.0, 5.0, 8.0, 12.5]) if m % 2 else rng.uniform(0, 20))
            members.append((school, m, pct, str(rng.choice(["PG", "SG", "SF", "PF", "C"])), *(float(x) for x in rng.normal(0, 1, 5)), bool(m % 3)))
    r = spark.createDataFrame(members, "school int, member long, min_pct double, position string, off double, deff double, three double, oreb double, usage double, known boolean")
    c = spark.createDataFrame([(k, 0.5, k % 4 + 1, None if k % 2 else 70.0) for k in range(12)], "school int, returning_share double, tier int, tempo double")
    pairs = [(s * 100 + k, s, float(rng.uniform(0, 40)), float(rng.choice([0.0, 5.0, 10.0, 20.0, 500.0, 37.3])), None if k == 2 else float(rng.normal()), [None, "C", "PG"][k % 3], 0.3, None, 22.0) for s in range(12) for k in range(8)]
    p = spark.createDataFrame(pairs, "pair long, school int, minutes double, displaced double, value double, cand_position string, cand_three double, cand_oreb double, cand_usage double")
    return r, c, p


def test_look_ups_equal_built_rosters(spark):
    r, c, p = tables(spark)
    want = rosters.roster_vector(rosters.candidate_rosters(p.join(r.select("school").distinct(), "school", "left_semi"), r).join(c, "school"), ["pair", "school"])
    got = rosters.after_displacement(p, rosters.displacement_index(r), c)
    a, b = ({x["pair"]: x for x in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 88
    for k in a:
        for f in rosters.ROSTER_FEATURES:
            assert np.isclose(a[k][f], b[k][f], rtol=1e-9, atol=1e-9), (k, f, a[k][f], b[k][f])


def test_a_pair_is_one_row(spark):
    r, c, p = tables(spark)
    df = rosters.after_displacement(p, rosters.displacement_index(r), c)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "explode" in x or "Window" in x and "pair#" in x]
    assert df.count() == p.join(r.select("school").distinct(), "school", "left_semi").count()
