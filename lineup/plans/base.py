"""Registration of queries and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x, name=None):
    """Six decimals, so that the order of additions does not show."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), 6).alias(name or x)


# the normal quantile in SQL, the same published approximation
def sql_quantile(p: str) -> str:
    from lineup.functions.scalars import _A, _B, _C, _D

    def poly(cs, x, last=None):
        out = repr(cs[0]) + "::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out if last is None else f"({out} * {x} + {last})"

    t = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    outer = f"({poly(_C, t)} / {poly(_D, t, '1.0::DOUBLE')})"
    return f"(CASE WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 1 - 0.02425 THEN -{outer} ELSE {poly(_A, r)} * {q} / {poly(_B, r, '1.0::DOUBLE')} END)"


def sql_score(p: str) -> str:
    """P30 in SQL."""
    held = f"least(greatest({p}, 1e-6::DOUBLE), 1::DOUBLE - 1e-6::DOUBLE)"
    return f"least(greatest(50 + 20 * {sql_quantile(held)}, 10), 90)"
