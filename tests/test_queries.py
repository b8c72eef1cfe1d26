"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quarrystone.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    theirs = duck.sql(catalogue.ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


#: Rows and sum of all numbers (six digits) of queries that SQL can't express, on the smallest tables.
GOLDEN = {
    "artifact_map": (125, 7751.93),
    "degraded_images": (41, 1.00089e06),
    "frechet_by_label": (10, 4.05803),
    "gaussian_noise": (500, 124720),
    "hash_sample": (500, 1.22e08),
    "jpeg_roundtrip": (125, 4.07955e06),
    "niqe_features": (125, 9316.84),
    "niqe_scores": (31, 741.835),
    "ordered_pool_stream": (743, 366022),
    "pair_pool_stream": (372, 107535),
    "poisson_noise": (125, 23725.8),
    "ssim": (125, 7867.64),
    "ssim_options": (41, 897.993),
}


def total(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return 0.0
    if isinstance(v, (int, float)):
        return 0.0 if isinstance(v, float) and math.isnan(v) else float(v)
    return sum(map(total, v.values() if isinstance(v, dict) else v))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_golden(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    count, value = GOLDEN[name]
    assert len(rows) == count
    assert sum(total(v) for r in rows for v in r) == pytest.approx(value, rel=2e-5)
