import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlane.llm import gru, lm
from emberlane.llm.queries import QUERIES, lm_held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
END = object()


def split(text):
    return [*WORD.findall((text or "").translate(UPPER)), END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base score by the definitions."""
    count = Counter(t for i, text in rows if not held(i) for t in split(text))
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        t = split(text)
        out.append((i, held(i), len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    kinds = [[a + b for a in "bcdfgh" for b in ("an", "en", "on", "in")], [a + b + "x" for a in "klmnp" for b in ("é", "ü", "ö", "ai")], [a + b for a in "rstvwz" for b in ("ab", "eb", "ob")]]
    rows = []
    for k in range(n):
        words = r.choice(kinds)
        text = " ".join(r.choice(words) if r.random() < 0.9 else r.choice(words) + str(r.randint(0, 400)) for _ in range(r.randint(1, 80)))
        rows.append((k, text.capitalize()))
    return [*rows, rows[3], rows[3], (3, "another text"), (None, "no id"), (None, None), (n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "word " * 60_000), (n + 4, "unseen" + " neverseen" * 3)]


SCHEMA = "doc_id long, text string, h long, n long, key long, ids binary, k1 long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, b"", 4, 5.0) for r in rows], SCHEMA).repartition(4)


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3]))


@pytest.mark.parametrize("options", [{}, {"known": 64, "pool_tokens": 500}, {"known": 0}, {"group_tokens": 3000, "fan": 2, "segment": 64, "words": 32, "width": 8}, {"least_tokens": 2000, "sample_every": 50}])
def test_base_matches_brute_force(spark, options):
    rows = corpus(1)
    got = by_key(tuple(r) for r in lm.score_documents(frame(spark, rows), lm_held_out(), **options).collect())
    for g, w in zip(got, by_key(brute(rows)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_model_beats_the_base(spark):
    got = lm.score_documents(frame(spark, corpus(2, 900)), lm_held_out()).collect()
    known = [r for r in got if r["held_out"] and 20 < r["n_tokens"] < 1000]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known) + 0.1 * sum(r["n_tokens"] for r in known)
    assert sum(r["score"] > r["base_score"] for r in known) > 0.9 * len(known)


def test_counts_beyond_the_known_change_nothing(spark):
    rows = corpus(3, 200)
    few, all_ = (by_key(tuple(r) for r in lm.score_documents(frame(spark, rows), lm_held_out(), known=k, words=16, width=4).collect()) for k in (40, 1 << 19))
    for a, b in zip(few, all_, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    only = [(i, "some words") for i in range(200) if held(i)]
    for r in lm.score_documents(frame(spark, only), lm_held_out()).collect():
        assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["base_score"] == r["score"] == 0.0
    assert lm.score_documents(frame(spark, only).limit(0), lm_held_out()).collect() == []


@pytest.fixture(scope="module")
def net():
    r = np.random.default_rng(0)
    p = gru.start_weights(r.integers(1, 50, 24) + 0.5, np.full(4, 9.5), 8, 6)
    return p.like(p.flat() + 0.3 * r.standard_normal(p.flat().size))


def plain(p, ids, words):
    """One symbol at a time, in doubles."""
    hidden, width = len(p.u), p.w.shape[2]
    h, last, total = np.zeros(hidden), len(p.x) - 1, 0.0
    for y in ids.tolist():
        a, g = p.x[last].astype(float), h @ p.u
        z, r = (1 / (1 + np.exp(-(a[k * hidden : (k + 1) * hidden] + g[k * hidden : (k + 1) * hidden]))) for k in (0, 1))
        n = np.tanh(a[2 * hidden :] + r * g[2 * hidden :])
        h = n + z * (h - n)
        s = h @ p.c + p.bc
        kind = y // width if y < words else y - words + len(p.w)
        total += s[kind] - np.log(np.exp(s).sum())
        if y < words:
            s = h @ p.w[kind] + p.bw[kind]
            total += s[y % width] - np.log(np.exp(s).sum())
        last = y
    return total


@pytest.mark.parametrize("lanes,steps", [(512, 32), (3, 4), (1, 1), (2, 1000)])
def test_windows_carry_the_state(net, lanes, steps):
    r = np.random.default_rng(1)
    size = [0, 1, 500, 3, 40, 0, 41, 7]
    first = np.concatenate([[0], np.cumsum(size)])
    ids = r.integers(0, 28, first[-1]).astype(np.uint16)
    got = gru.score(net, ids, first, 24, lanes, steps)
    assert np.allclose(got, [plain(net, ids[a:b], 24) for a, b in zip(first[:-1], first[1:])], rtol=1e-4)


def test_probabilities_sum_to_one(net):
    h = np.random.default_rng(2).standard_normal((1, 6)).astype(np.float32)
    assert math.isclose(sum(np.exp(gru.log_probability(net, np.repeat(h, 28, 0), np.arange(28), 24))), 1, rel_tol=1e-5)


def test_gradients(net):
    """A step of training goes where the loss, measured by differences, falls."""
    r = np.random.default_rng(3)
    ids, first = r.integers(0, 28, 12).astype(np.uint16), np.array([0, 5, 12])
    loss = lambda p: -sum(plain(p, ids[a:b], 24) for a, b in zip(first[:-1], first[1:]))
    new = gru.train(net, ids, first, 24, lanes=2, steps=7, rate=1e-3)
    moved = new.flat() - net.flat()
    flat = net.flat().astype(float)
    checked = 0
    for k in np.flatnonzero(np.abs(moved) > 5e-4)[::9]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = loss(net.like(up)) - loss(net.like(down))
        if abs(slope) > 1e-3:
            assert slope * moved[k] < 0
            checked += 1
    assert checked >= 15 and loss(new) < loss(net)


def test_query(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = by_key(tuple(r) for r in QUERIES["op12_lm_score"](spark, "/root/testdata/sf0.001").collect())
    for g, w in zip(got, by_key(brute(rows)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
