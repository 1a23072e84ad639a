import random

import pytest

from emberlane.operators.asof import asof_join


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 4, 50])
def test_asof_join(spark, strict, parts):
    r = random.Random(parts)
    key = lambda: r.choice(("hot", "hot", "hot", "b", "c", None))
    left = [(k, key(), r.choice((None, *range(60)))) for k in range(400)]
    right = [(key(), r.choice((None, *range(0, 60, 3))), r.randint(0, 9)) for _ in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a = spark.createDataFrame(left, "id long, g string, t long")
        b = spark.createDataFrame(right, "g string, t long, v int")
        got = {x.id: (x.v, x.at) for x in asof_join(a, b.selectExpr("g", "t AS at", "v"), ["g"], "t", "at", ["at", "v"], strict).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k, g, t in left:
        fit = [(x, v) for h, x, v in right if h == g and g is not None and t is not None and x is not None and (x < t if strict else x <= t)]
        assert got[k] == (max(fit)[::-1] if fit else (None, None))


def test_keys_of_two_columns_and_clashing_names(spark):
    a = spark.createDataFrame([(1, "x", 1, 5, 0), (2, "x", 2, 5, 0), (3, "y", 1, 1, 0)], "id long, g string, h int, t long, _b int")
    b = spark.createDataFrame([("x", 1, 4, "in"), ("x", 2, 6, "late"), ("y", 1, 1, "same")], "g string, h int, at long, v string")
    got = {x.id: x.v for x in asof_join(a, b, ["g", "h"], "t", "at", ["v"]).collect()}
    assert got == {1: "in", 2: None, 3: "same"}
    assert asof_join(a.limit(0), b, ["g"], "t", "at", ["v"]).collect() == []
    assert {x.v for x in asof_join(a, b.limit(0), ["g"], "t", "at", ["v"]).collect()} == {None}
