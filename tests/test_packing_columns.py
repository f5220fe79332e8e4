"""The 16-bit packing keeps every row of lineitem, and the whole quantity."""

from collections import Counter

from rasterloom.plans.catalog import QUERIES


def test_every_row_is_packed(spark, sf):
    got = Counter((r["l_orderkey"], r["word"] // 1024 * 2 + r["low"], r["word"] // 32 % 32, r["word"] % 32) for r in QUERIES["a08_pack_columns"](spark, sf).collect())
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    assert got == Counter((r["l_orderkey"], int(r["l_quantity"]), round(r["l_discount"] * 100), round(r["l_tax"] * 100)) for r in rows)
