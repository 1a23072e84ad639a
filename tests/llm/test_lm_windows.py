import numpy as np

from emberlane.llm import gru


def test_places_are_found_for_many_windows_at_once(monkeypatch):
    """Each window was sorted twice, by class and by symbol, and its places were found one by one."""
    r = np.random.default_rng(4)
    first = np.arange(0, 40_001, 100)
    ids = np.minimum(r.zipf(1.2, first[-1]), 4127).astype(np.uint16)
    net = gru.start_weights(np.bincount(ids, minlength=4128)[:4096] + 0.5, np.full(32, 9.5), 64, 16)
    sorts, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: (sorts.append(1), real(*a, **k))[1])
    gru.train(net, ids, first, 4096)
    windows = first[-1] // (64 * 16)
    assert len(sorts) < windows


def test_sums_by_pairs():
    r = np.random.default_rng(6)
    window, symbol = np.repeat(np.arange(3), [50, 1, 29]), np.minimum(r.zipf(1.3, 80), 11)
    row = np.concatenate([r.permutation(50), [7], r.permutation(29)])
    rows = np.concatenate([r.standard_normal((50, 4)).astype(np.float32), np.zeros((1, 4), np.float32)])
    for i, sums in enumerate(gru._place_sums(window, 3, symbol, 12, row, 50)):
        want = np.zeros((12, 4))
        np.add.at(want, symbol[window == i], rows[row[window == i]])
        got = np.zeros((12, 4))
        got[sums.symbols] = sums(rows)
        assert sorted(sums.symbols) == sorted(set(symbol[window == i])) and np.allclose(got, want, atol=1e-5)
