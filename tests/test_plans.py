"""Registered queries against their SQL on the smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from tidemark.plans import catalog  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, str):
        return v
    return float(v)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False)), key=lambda r: [str(type(v)) + (f"{v:.5f}" if isinstance(v, float) else str(v)) for v in r])


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))
