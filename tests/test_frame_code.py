"""The code that Spark makes for the features of a player's season has to stay below what the JVM compiles (8,000 bytes a method), too."""

import io
import re
from contextlib import redirect_stdout

from lineup.plans import registry


def test_features_are_compiled(spark):
    # tables of size are joined by sorted shuffles, small ones would all be broadcast into one stage
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    df, said = registry.QUERIES["P61b_opportunity_frame"](spark, "/root/testdata/sf0.001"), io.StringIO()
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        with redirect_stdout(said):
            df.explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) < 8000
