"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from trajspark.plans import catalogue, storage, structures, transforms  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(one(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
