import random
from collections import Counter

import numpy as np
import pytest

from emberlane.operators.aggregates import HeavyHitters, Moments, Quantiles, aggregate


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(r.choice(("hot", "hot", "hot", "cold", None)), r.choice((None, round(r.gauss(10, 5), 3), float(int(r.paretovariate(1.0)))))) for _ in range(6000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(*x, 1) for x in rows], "k string, v double, _state int").repartition(9)


@pytest.mark.parametrize("fan", [32, 2])
def test_moments(df, rows, fan):
    got = {x.k: x for x in aggregate(df, ["k"], "v", Moments(), fan).collect()}
    for k in ("hot", "cold", None):
        mine = [v for g, v in rows if g == k and v is not None]
        assert got[k].n == len(mine) and got[k].mean == pytest.approx(np.mean(mine)) and got[k].variance == pytest.approx(np.var(mine, ddof=1))


@pytest.mark.parametrize("size,fan", [(1024, 32), (64, 2), (32, 4)])
def test_quantiles_are_within_their_bound(df, rows, size, fan):
    at = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    for x in aggregate(df, ["k"], "v", Quantiles(at, size), fan).collect():
        mine = np.sort([v for g, v in rows if g == x.k and v is not None])
        assert x.n == len(mine)
        for q, value in zip(at, x.quantiles):
            low, high = np.searchsorted(mine, value, "left") / len(mine), np.searchsorted(mine, value, "right") / len(mine)
            assert low - x.error <= q <= high + x.error


@pytest.mark.parametrize("size,fan", [(8, 2), (64, 32)])
def test_heavy_hitters(spark, size, fan):
    r = random.Random(2)
    rows = [(g, int(r.paretovariate(0.7))) for g in "ab" for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(8)
    for x in aggregate(df, ["g"], "v", HeavyHitters(size, top=size), fan).collect():
        true = Counter(v for g, v in rows if g == x.g)
        assert x.n == 3000 and x.error <= 3000 / (size + 1)
        assert all(true[v] - x.error <= n <= true[v] for v, n in zip(x["values"], x.counts))
        assert {v for v, n in true.items() if n > x.error} <= set(x["values"])


def test_without_keys_and_without_rows(spark, df, rows):
    every = [v for _, v in rows if v is not None]
    assert aggregate(df, [], "v", Moments(), 2).first()["n"] == len(every)
    assert aggregate(df.limit(0), ["k"], "v", Moments()).collect() == []
    assert aggregate(spark.createDataFrame([(1, 2.0)], "k int, v double"), ["k"], "v", Moments()).first()[:] == (1, 1, 2.0, None)


def test_only_states_are_shuffled(df):
    plan = aggregate(df, ["k"], "v", Moments())._jdf.queryExecution().executedPlan().toString()
    assert "_state" in plan and "collect_list" not in plan
