"""Events are counted before the match, which reads only a row an actor."""

from lineup.operators import identity as I


def test_match_does_not_read_the_events_again(spark, tmp_path):
    rows = [(1, "ann poe", "B1", "PG"), (1, "ann poe", None, "SG"), (1, "ana poe", "B2", "SG"), (2, "bo lee", "B9", None), (3, None, "B1", "PG")]
    spark.createDataFrame(rows, "actor long, name string, team string, position string").write.parquet(f"{tmp_path}/events")
    schools = spark.createDataFrame([("B1", 1), ("B2", 2)], "team string, school int")
    roster = spark.createDataFrame([(7, "ann poe", "SG", 1), (8, "bo lee", "PG", 1)], "member long, member_name string, member_position string, school int")
    got, counts = I.crosswalk_table(spark.read.parquet(f"{tmp_path}/events"), schools, roster)
    assert not any(str(tmp_path) in f for f in [*got.inputFiles(), *counts.inputFiles()])
    found = {r["actor"]: (r["name"], r["team"], r["position"], r["school"], r["member"], r["status"]) for r in got.collect()}
    assert found == {1: ("ann poe", "B1", "SG", 1, 7, "matched"), 2: ("bo lee", "B9", None, None, None, "no_school")}
    assert {r["status"]: r["rows"] for r in counts.collect()} == {"matched": 1, "no_school": 1}
