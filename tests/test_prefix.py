import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators.prefix import AFFINE, CLAMPED, machine, prefix, sums


def rows(seed, n=600):
    r = random.Random(seed)
    out = [(r.choice(("hot", "hot", "hot", "b", None)), k, r.choice((-0.3, 0.2, 0.0)), r.choice((-float("inf"), -1.0, 0.0)), r.choice((float("inf"), 1.0, 0.5))) for k in range(n)]
    return out


def walked(data, step, start):
    state, out = {}, {}
    for row in sorted(data, key=lambda x: x[1]):
        state[row[0]] = out[row[0], row[1]] = step(state.get(row[0], start), row)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_clamped_values(spark, parts):
    data = rows(1)
    df = spark.createDataFrame(data, "g string, k long, a double, lo double, hi double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(x.g, x.k): min(max(0.1 + x.a, x.lo), x.hi) for x in prefix(df, ["g"], [F.col("k")], CLAMPED).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == pytest.approx(walked(data, lambda t, x: min(max(t + x[2], x[3]), x[4]), 0.1))


def test_affine_and_sums(spark):
    data = [(g, k, 0.5 + a, lo) for g, k, a, lo, _ in rows(2) if lo > -2]
    df = spark.createDataFrame(data, "g string, k long, m double, c double").repartition(7)
    got = {(x.g, x.k): x.m * 2 + x.c for x in prefix(df, ["g"], [F.col("k")], AFFINE).collect()}
    assert got == pytest.approx(walked(data, lambda t, x: x[2] * t + x[3], 2.0))
    one = {x.k: (x.m, x.c) for x in prefix(df, [], [F.col("k")], sums("m", "c")).collect()}
    upto = np.cumsum([(x[2], x[3]) for x in sorted(data, key=lambda x: x[1])], axis=0)
    assert [one[k] for k in sorted(one)] == [pytest.approx(tuple(x)) for x in upto]


def test_machine(spark):
    r = random.Random(3)
    data = [(g, k, r.choice((-1, 0, 1))) for g, k, *_ in rows(3)]
    df = spark.createDataFrame(data, "g string, k long, side int")
    inf = float("inf")
    columns = {}
    for s, turns in ((0, 0), (1, 1), (2, -1)):
        moves = F.col("side") == F.lit(turns) if turns else F.lit(False)
        columns |= {f"to_{s}": F.when(moves | (F.col("side") == 0), 0.0).when(F.col("side") > 0, 1.0).otherwise(2.0), f"a_{s}": F.when(moves, F.col("side") * 0.1).otherwise(0.0), f"lo_{s}": F.when(moves, -0.2).otherwise(-inf), f"hi_{s}": F.when(moves, 0.3).otherwise(inf)}

    def step(state, row):
        t, streak = state
        side = row[2]
        if side and side == streak:
            return (min(max(t + side * 0.1, -0.2), 0.3), 0)
        return (t, side)

    got = {(x.g, x.k): min(max(x.a_0, x.lo_0), x.hi_0) for x in prefix(df.withColumns(columns), ["g"], [F.col("k")], machine(3)).collect()}
    assert got == pytest.approx({k: t for k, (t, _) in walked(data, step, (0.0, 0)).items()})


def test_empty(spark):
    assert prefix(spark.createDataFrame([], "k long, m double, c double"), [], [F.col("k")], AFFINE).collect() == []
