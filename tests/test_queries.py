"""Every registered query against its oracle in DuckDB."""

import duckdb
import pytest

from latticebits.plans import binding, catalogue, features  # noqa: F401  features registers more queries

DATA = "/root/testdata/sf0.001"
SLOW = {"nested_cv_folds", "newton_fit", "damped_fit"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in binding.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def text(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name not in catalogue.ORACLE:
        assert got
        return
    found = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert text(got) == text([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4
