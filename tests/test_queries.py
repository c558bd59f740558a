"""Every registered query of the library beside its SQL in DuckDB, on the smallest tables."""

import itertools
import math
from collections import Counter

import duckdb
import pytest

from lumenmesh.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == expected
    assert got


def test_progress_is_rounded_as_in_sql_in_any_order(spark, tmp_path):
    tied = [71.42, 88.68, 91.6, 100.0, 100.0, 100.0]  # 91.95 or just below it, by the order of summing
    orders = sorted(set(itertools.permutations(tied)))[::3]
    rows = [(6 * u + k, u, v) for u, order in enumerate(orders) for k, v in enumerate(order)]
    beside = {1000: 20.099999999999998, 1001: 41.699999999999996, 1002: 5.1000000000000005, 1003: 594.9}  # next to ties
    rows += [(6 * u + k, u, min(v - 100.0 * k, 100.0)) for u, v in beside.items() for k in range(6) if v > 100.0 * k]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = dict(tuple(r) for r in catalog.queries()["progress_rollup"](spark, str(tmp_path)).select("user_id", "progress").collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(c.sql(f"SELECT user_id, progress FROM ({catalog.oracle_sql()['progress_rollup']})").fetchall())
    assert {u: got[u] for u in beside} == {u: want[u] for u in beside}
    assert {got[u] for u in range(len(orders))} == {92.0}


def test_region_is_filled_where_the_grid_has_no_pixel(spark, tmp_path):
    rows = [(px + 64 * py, 3.0 * px + py) for px, py in ((20, 16), (27, 18), (60, 30), (63, 0), (21, 24), (45, 45))]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = Counter((r.px, r.py, plain(r.value)) for r in catalog.queries()["fill_region2"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = Counter((px, py, plain(v)) for px, py, v in c.sql(f"SELECT px, py, value FROM ({catalog.oracle_sql()['fill_region2']})").fetchall())
    assert got == want and len(want) > 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
