"""The registered queries against SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(rows):
    return sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in rows)


def names():
    from lodeline.llm import queries

    return sorted(queries.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from lodeline.llm import queries

    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got) == len(set(got))
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    r = con.execute(sql)
    have = [x[0] for x in r.description]
    order = sorted(range(len(have)), key=lambda i: have[i])
    assert [have[i] for i in order] == cols
    assert plain([tuple(x[i] for i in order) for x in r.fetchall()]) == got


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """The smallest tables emptied, and with rows of nothing but nulls put among them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        pq.write_table(t.slice(0, 0), empty / f.name)
        pq.write_table(pa.concat_tables([t.schema.empty_table(), pa.Table.from_pylist([{}] * 3, schema=t.schema), t]), nulls / f.name)
    return empty, nulls


@pytest.mark.parametrize("name", [n for n in names() if n.endswith("_found")])
def test_empty_tables_and_null_rows(spark, odd_tables, name):
    from lodeline.llm import queries

    q = queries.queries()[name]
    empty, nulls = odd_tables
    assert q(spark, str(empty)).count() == 0
    assert plain(q(spark, str(nulls)).collect()) == plain(q(spark, str(DATA)).collect())
