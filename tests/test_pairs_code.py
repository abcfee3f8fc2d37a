"""The code that Spark makes for a pair of the all-pairs fits has to stay below what the JVM compiles (8,000 bytes a method)."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lineup.functions.scalars import rounded
from lineup.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["C04_scheme_fit", "C05_gap_match"])
def test_pairs_are_compiled(spark, name):
    df, said = registry.QUERIES[name](spark, DIR), io.StringIO()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with redirect_stdout(said):
            df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) < 8000


def test_rounded(spark):
    df = spark.createDataFrame([(1.0000005,), (-2.5,), (-1e-9,), (99.9999996,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(rounded(F.col("x"), 0)).collect()]
    assert got[:4] == [1.0, -3.0, 0.0, 100.0] and str(got[2]) == "0.0" and got[4] != got[4] and got[5] is None
