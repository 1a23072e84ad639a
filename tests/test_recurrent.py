import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlane.operators import recurrent, scoring
from emberlane.plans import all_queries


def plain(w, rows):
    """One sequence, one number at a time where that is how it is defined."""
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    xs = []
    for x in np.asarray(rows, dtype=float):
        xs.append((x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean() + 1e-5) * w["norm_scale"] + w["norm_shift"])
    n = 0
    while f"x{n}" in w:
        hidden = len(w[f"h{n}"])
        h, c, out = np.zeros(hidden), np.zeros(hidden), []
        for x in xs:
            a = x @ w[f"x{n}"] + h @ w[f"h{n}"] + w[f"b{n}"]
            i, f, g, o = a[:hidden], a[hidden : 2 * hidden], a[2 * hidden : 3 * hidden], a[3 * hidden :]
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        xs, n = out, n + 1
    return sigmoid(h @ w["out_w"] + w["out_b"][0])


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    sequences = [[[r.random() for _ in range(7)] for _ in range(r.randint(1, 10))] for _ in range(800)]
    return sequences, [float(s[-1][0] > s[-1][1]) for s in sequences]


def test_batches_equal_the_recurrence(spark, data):
    w = recurrent.start(7, 8, 2)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(data[0])], "k int, s array<array<double>>").repartition(3)
    got = {x.k: x.probability for x in recurrent.score(df, "s", w).collect()}
    assert len(set(got.values())) > 700
    for k, s in enumerate(data[0]):
        assert got[k] == pytest.approx(plain(w, s), abs=1e-12)


def test_gradients():
    r = np.random.default_rng(1)
    w = recurrent.start(3, 4, 2)
    x, size, y = r.standard_normal((5, 4, 3)), np.array([4, 1, 3, 2, 4]), np.array([1.0, 0, 1, 1, 0])

    def loss(w):
        p, _ = recurrent.forward(w, x, size)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    p, kept = recurrent.forward(w, x, size, keep=True)
    for name, g in recurrent._backward(w, x, p, y, kept).items():
        for at in np.ndindex(*w[name].shape):
            if r.random() < 0.3:
                up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
                up[name][at] += 1e-5
                down[name][at] -= 1e-5
                assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), (name, at)


def test_fitting_learns_and_weights_are_a_table(spark, data):
    df = spark.createDataFrame([(k, s, int(y)) for k, (s, y) in enumerate(zip(*data))], "k int, s array<array<double>>, y int")
    w = recurrent.fit(df.where("k < 640"), "s", "y", ["k"], hidden=12, passes=20)
    again = recurrent.from_table(recurrent.to_table(spark, w))
    assert all(np.array_equal(w[k], again[k]) for k in w)
    p = {x.k: x.probability for x in recurrent.score(df, "s", again).collect()}
    held = [(p[k] > 0.5) == bool(y) for k, y in enumerate(data[1]) if k >= 640]
    assert np.mean(held) > 0.85 and np.mean(data[1][640:]) < 0.75


def test_padding():
    x, size = recurrent.padded(pa.array([[[1.0, 2.0]], [], [[3.0, 4.0], [5.0, 6.0]]], pa.list_(pa.list_(pa.float64()))).slice(1), 2)
    assert size.tolist() == [0, 2] and x[1].tolist() == [[3, 4], [5, 6]] and not x[0].any()


def test_without_weights_nothing_is_blocked(spark):
    df = spark.createDataFrame([(1, 1, *[0.5] * 7)], "session_id long, step long, " + ", ".join(f"{c} double" for c in scoring.FEATURES))
    assert scoring.sequence_score(df).select("probability", "available", "blocked").first()[:] == (0.0, False, False)


def test_query_scores_every_step(spark):
    got = all_queries()["lstm_score"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
    x = got.agg(F.count("probability").alias("n"), F.countDistinct("probability").alias("kinds"), F.min("probability").alias("low"), F.max("probability").alias("high")).first()
    assert x.n == n and x.kinds > n / 2 and 0 < x.low < x.high < 1
