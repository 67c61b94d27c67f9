"""Every registered query with SQL gives what DuckDB gives; the others give rows."""

import math

import pytest

from lodegraph import plans

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(rows):
    def of(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        if hasattr(v, "as_integer_ratio"):
            return f"{float(v):.6g}"
        return str(v)

    return sorted([[of(v) for v in r] for r in rows])


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, con, name):
    cursor = con.execute(plans.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    df = plans.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0
