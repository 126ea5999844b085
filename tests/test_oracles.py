"""Every query with SQL against DuckDB over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from textloom.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or (isinstance(v, float) and v != v) else f"{v + 0:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got) > 0
        return
    want = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
