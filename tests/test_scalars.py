import duckdb

from emberlane.plans import all_oracles, all_queries


def test_scalar_string_of_long_keys_and_nulls(spark, tmp_path):
    """keys of six digits, below zero and null, segments of two words, and null texts, against the SQL."""
    rows = [(99_999, "Customer#1", "BUILDING"), (123_456, "Customer#2", "MACHINERY"), (-7, " c ", "TWO WORDS"), (None, "n", "i"), (5, None, "AUTOMOBILE"), (6, "x#y", None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = all_queries()["scalar_string"](spark, str(tmp_path))
    want = con.execute(all_oracles()["scalar_string"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
