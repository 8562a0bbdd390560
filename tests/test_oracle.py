"""Registered queries against their SQL at the smallest scale, and the entry contract."""

import pathlib

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

#: one of each kind; the whole list is compared by the driver
SAMPLE = ["state_counts", "stack_groups", "contended_locks", "transitive_victims", "pool_trend", "pause_covers",
          "evaluate_rules", "parse_gc_log", "similar_incidents", "threshold_trigger"]


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(SAMPLE) <= set(sql)
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not pathlib.Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    want = sorted([tuple(norm(v) for v in r) for r in cur.fetchall()], key=repr)
    assert got == want
