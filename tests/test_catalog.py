"""Every registered query of the frame operators against its SQL, and the contract of the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
from rasterloom.plans import catalog, relational  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        return "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name in catalog.SQL:
        out = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
        assert plain(rows) == plain(out)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
