import random

import numpy as np
import pytest

import corpus_pipeline
from emberlane.llm import neardup


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [1024, 2])
def test_stage_links_all_that_are_similar_by_four_fifths(spark, most):
    """With ``most`` = 2 every group of candidates is compared in blocks."""
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 5000)}"
    texts = []
    for k in range(60):
        base = [word() for _ in range(r.choice((30, 120, 300)))]
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(0, len(copy) // 30)):
                copy[at] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]  # a long row of texts of which only neighbours are alike
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[5:] + [word() for _ in range(5)]
    texts += [None, "", "one two", "One  two", "one two three"]
    r.shuffle(texts)
    part = list(range(len(texts)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    edited = 0
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                edited += texts[a] != texts[b]
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    assert edited > 50
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, most=most).collect()}
    assert got == {None: find(0)} | {k: find(k) for k in range(len(texts))}
    kept = {x.doc_id for x in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "").collect()}
    assert kept == {k for k in range(len(texts)) if find(k) == k}  # a copy without an id goes like any other


def test_empty_table(spark):
    assert not neardup.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_simhash_gives_candidates(spark, monkeypatch):
    """the stage had MinHash in place of SimHash; now near fingerprints are compared too, though no key be common."""
    r = random.Random(11)
    base = [f"w{r.randint(0, 9000)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{r.randint(0, 9000)}" for _ in range(3000))]
    sets = [neardup.shingle_set(t.encode()) for t in texts]
    assert neardup._joined(sets, np.arange(120).reshape(3, 40), 0.8).tolist() == [0, 0, 2]
    asked = []
    real = neardup.near_links
    monkeypatch.setattr(neardup, "near_links", lambda prints: (asked.append(prints.count()), real(prints))[1])
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[0]), (4, None)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4} and 3 <= asked[0] <= 4
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, 7), (4, 1 << 40), (5, -1)], "fp long, sim long")
    assert {tuple(x) for x in neardup._sim_links(prints).collect()} == {(3, 2), (2, 1), (4, 1)}
