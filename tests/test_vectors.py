import random

import numpy as np
import pytest

from emberlane.operators import vectors
from emberlane.plans import all_queries


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    anchors = centres[r.integers(0, 40, 1200)] + 0.4 * r.standard_normal((1200, 16))
    queries = centres[r.integers(0, 40, 700)] + 0.4 * r.standard_normal((700, 16))
    queries[0], anchors[5] = anchors[7], anchors[7]  # equal anchors: the smaller id counts
    return anchors, queries


def frames(spark, data):
    make = lambda rows, name: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rows)], f"{name} long, v array<double>").repartition(4)
    return make(data[0], "a"), make(data[1], "q")


def brute(data):
    anchors, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in data)
    return queries @ anchors.T


@pytest.mark.parametrize("options", [{"probes": 1000}, {"probes": 1000, "lists": 7, "block": 50, "part": 64}])
def test_all_lists_are_exact(spark, data, options):
    a, q = frames(spark, data)
    got = {x.q: (x.a, x.similarity) for x in vectors.nearest(q, a, "q", "a", "v", **options).collect()}
    near = brute(data)
    for k in range(len(near)):
        assert got[k][1] == pytest.approx(near[k].max(), abs=1e-9) and near[k][got[k][0]] == pytest.approx(near[k].max(), abs=1e-9)
    assert got[0][0] == 5


def test_recall_of_few_lists(spark, data):
    a, q = frames(spark, data)
    got = {x.q: x.a for x in vectors.nearest(q, a, "q", "a", "v", probes=8).collect()}
    near = brute(data)
    found = np.mean([near[k][got[k]] >= near[k].max() - 1e-9 for k in range(len(near))])
    assert len(got) == len(near) and found >= 0.9


def test_small_tables(spark, data):
    a, q = frames(spark, data)
    assert vectors.nearest(q, a.limit(0), "q", "a", "v").collect() == [] and vectors.nearest(q.limit(0), a, "q", "a", "v").collect() == []
    assert {x.a for x in vectors.nearest(q, a.where("a = 3"), "q", "a", "v").collect()} == {3}


def test_texts_that_are_alike_are_near(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=25)) for _ in range(200)]
    changed = [t.replace(t.split()[3], "other").upper() for t in texts]
    a = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    q = spark.createDataFrame([*enumerate(changed), (900, None), (901, "x")], "q long, text string")
    encoder = vectors.fit_encoder(a, "text")
    made = vectors.encode(q, "text", encoder)
    assert {x.q: any(x.vector) for x in made.where("q >= 900").collect()} == {900: False, 901: False}
    got = {x.q: (x.a, x.similarity) for x in vectors.nearest(made, vectors.encode(a, "text", encoder), "q", "a", "vector").collect()}
    assert np.mean([got[k][0] == k for k in range(200)]) >= 0.95 and np.mean([got[k][1] for k in range(200)]) > 0.85


def test_recall_on_benchmark_passages(spark):
    """The query's answers against all cosines."""
    sf = "/root/testdata/sf0.01"
    got = all_queries()["semantic_anchor_text"](spark, sf).collect()
    from emberlane.sources.views import view

    anchors = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    actions = view(spark, sf, "actions").selectExpr("session_id * 1000 + step AS id", "action AS text")
    encoder = vectors.fit_encoder(anchors.select("text").unionAll(actions.select("text")), "text")
    signs = encoder.signs()
    rows, items = actions.collect(), anchors.collect()
    near = encoder.encode([x.text for x in rows], signs) @ encoder.encode([x.text for x in items], signs).T
    best = {x.id: near[k].max() for k, x in enumerate(rows)}
    assert len(got) == len(rows) and np.mean([x.similarity >= best[x.id] - 1e-5 for x in got]) >= 0.9
