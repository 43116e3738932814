"""The core's registered queries against SQL on the smallest tables, and the driver's contract."""

from pathlib import Path

import pytest

from lodeline.plans import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
NAMES = sorted(Q.queries())


def plain(rows):
    return sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = Q.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    sql = Q.oracle_sql().get(name)
    if sql is None:
        return
    r = con.execute(sql)
    have = [x[0] for x in r.description]
    order = sorted(range(len(have)), key=lambda i: have[i])
    assert [have[i] for i in order] == cols
    assert plain([tuple(x[i] for i in order) for x in r.fetchall()]) == got


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["repo_id", "subject", "partner", "n", "width", "place"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("empty")
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        pq.write_table(t.slice(0, 0), d / f.name)
    return d


#: These count over everything, so they have a row for nothing.
ONE_ROW = {"summary", "spread_ratio", "layout_spread", "witness_round_trip"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    n = Q.queries()[name](spark, str(empty)).count()
    assert n == 0 or name in ONE_ROW
