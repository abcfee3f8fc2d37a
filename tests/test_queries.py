"""Every registered query of the library against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from lineup.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return str(v).replace("+00:00", "")


def key(row):
    return tuple((x is None, str(type(x)), f"{x:.4g}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    res = con.execute(registry.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def test_entry_imports_without_a_session():
    """The driver reads the names of the queries before it has a session."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
