import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["clusters_len", "prep_stats", "run_metrics", "quality_inventory_agrees", "leakage_raw"])
def test_against_sql(spark, name):
    from shobdo.plans import core

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = core.QUERIES[name](spark, DATA)
    cur = con.execute(core.SQL[name])
    names = [c[0] for c in cur.description]
    clean = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v
    want = sorted(tuple(str(clean(v)) for v in r) for r in cur.fetchall())
    got = sorted(tuple(str(clean(r[c])) for c in names) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want
