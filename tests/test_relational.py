"""The outer joins over whole tables, on rows that the given tables lack."""

from rasterloom.plans.catalog import QUERIES


def test_outer_joins_keep_every_match(spark, tmp_path):
    """Nation 1 has both sides, 2 only suppliers, 3 only customers, 4 neither; no key is a multiple of ten."""
    spark.createDataFrame([(k, f"n{k}", 0) for k in (1, 2, 3, 4)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(11, 1), (12, 1), (13, 1), (None, 1), (14, 2), (15, None), (16, 9)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(21, 1), (22, 1), (23, 3), (24, 9), (25, None), (None, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["n_name"]: (r["suppliers"], r["customers"]) for r in QUERIES["b_outer_joins"](spark, str(tmp_path)).collect()}
    assert got == {"n1": (6, 8), "n2": (1, 0), "n3": (0, 1), "n4": (0, 0), None: (0, 2)}
