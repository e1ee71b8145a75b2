"""Every catalogued query against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

from quire.plans import catalog, documents  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(norm(r[c]) for c in names) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect()


def test_storage_beyond_the_units_and_at_halves(spark, sf, tmp_path):
    """Large keys, whose bytes have no unit (mobi), and repeated ones, whose bytes end in half a hundredth (azw3)."""
    c = duckdb.connect()
    keys = [1_199_995] * 100 + [8] * 5 + [0, 3]
    c.execute(f"COPY (SELECT p.* REPLACE (k AS p_partkey) FROM (SELECT * FROM '{sf}/part.parquet' LIMIT 1) p, (SELECT unnest({keys})::BIGINT AS k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["a21_storage"](spark, str(tmp_path)).select("kind", "bytes", "size").collect())
    assert got == sorted(c.execute(catalog.SQL["a21_storage"]).fetchall())
    assert [(kind, size) for kind, _, size in got] == [("azw3", "3.12 KB"), ("epub", "0 B"), ("fb2", "90.00 B"), ("mobi", None)]
