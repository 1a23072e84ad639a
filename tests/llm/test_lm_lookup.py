import time

import numpy as np

from emberlane.llm import gru, lm


def vocabulary(keys):
    return lm.Vocabulary(keys, np.arange(len(keys)), np.arange(len(keys)).astype(np.uint16), 4096)


def test_place_finds_what_is_there():
    r = np.random.default_rng(0)
    top = np.uint64(2**64 - 1)
    wide, near = r.integers(0, 2**64, 5000, dtype=np.uint64), np.uint64(7 << 60) + r.integers(0, 900, 300, dtype=np.uint64)
    for keys in (np.unique(wide), np.unique(near), np.unique(np.append(wide, np.array([0, top], np.uint64))), np.array([0], np.uint64), np.array([top])):
        h = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), wide, near, np.array([0, top], np.uint64)])
        at, known = vocabulary(keys).place(h)
        assert (known == np.isin(h, keys)).all() and (keys[at[known]] == h[known]).all()


def test_lookup_is_no_binary_search():
    """Tokens took longer to look up than to split and hash; they are looked up once in training and twice for each score."""
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**64, 1 << 19, dtype=np.uint64))
    v, h = vocabulary(keys), keys[np.minimum(r.zipf(1.1, 500_000), len(keys)) - 1]

    def least(f):
        took = []
        for _ in range(5):
            start = time.perf_counter()
            f()
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(lambda: v.look(h)) < least(lambda: np.searchsorted(keys, h))


def test_word_slopes_match_each_class_by_itself():
    r = np.random.default_rng(2)
    w = r.standard_normal((5, 7, 8))
    kind, at = r.choice(5, 90, p=[0.7, 0.2, 0.07, 0.03, 0]), r.integers(0, 8, 90)
    s = r.standard_normal((90, 7))
    back, gw = gru._word_slopes(s.astype(np.float32), w.astype(np.float32), kind, at, np.float32(1 / 90))
    want_back, want = np.zeros_like(s), np.zeros_like(w)
    for i, (k, y) in enumerate(zip(kind, at)):
        p = np.exp(s[i] @ w[k])
        p /= p.sum()
        p[y] -= 1
        want_back[i] = w[k] @ p / 90
        want[k] += np.outer(s[i], p) / 90
    assert np.allclose(back, want_back, atol=1e-5) and np.allclose(gw, want, atol=1e-5)
