"""A small gated recurrent language model with a class-factored softmax, in numpy.

Symbols 0 .. ``words - 1`` are words, the next ``tails`` ones are classes of all other words, and the last one starts a text. A symbol
indexes its input to the gates; the output is a class and then, for words, a word within its class of ``width``.
Many texts run side by side, each in a lane, one step at a time; a lane's state goes on from window to window until its text ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import pairwise, repeat

import numpy as np


@dataclass
class Weights:
    """``x``: symbol to gates (update, reset, new); ``u``: state to gates; ``c, bc``: state to class; ``w, bw``: state to word of its class."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    bc: np.ndarray
    w: np.ndarray
    bw: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for f in fields(self):
            v = getattr(self, f.name)
            out.append(flat[at : at + v.size].reshape(v.shape).astype(np.float32))
            at += v.size
        return Weights(*out)


def start_weights(word_mass: np.ndarray, tail_mass: np.ndarray, width: int, hidden: int, seed: int = 7) -> Weights:
    """Weights that predict by the given masses alone, whatever came before; words come in order of their class."""
    r = np.random.default_rng(seed)
    classes = -(-len(word_mass) // width)
    mass = np.zeros(classes * width)
    mass[: len(word_mass)] = word_mass
    by_class = mass.reshape(classes, width)
    total = np.concatenate([by_class.sum(axis=1), tail_mass])
    bw = np.full(mass.shape, -60.0)
    bw[: len(word_mass)] = np.log(word_mass / np.repeat(by_class.sum(axis=1), width)[: len(word_mass)])
    f = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
    x = f(len(word_mass) + len(tail_mass) + 1, 3 * hidden, by=0.5)
    x[:, :hidden] += 1  # states last at first
    return Weights(x, f(hidden, 3 * hidden, by=0.5 / np.sqrt(hidden)), f(hidden, len(total), by=0.05), np.log(total / total.sum()).astype(np.float32), f(classes, hidden, width, by=0.05), bw.reshape(classes, width).astype(np.float32))


#: Rows that are taken at once, so that their products stay in a core's cache.
_ROWS = 1024
#: Words of one class that are multiplied by its weights at once.
_BLOCK = 8


def _by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(kind, kind="stable")
    return order, np.searchsorted(kind[order], np.arange(classes + 1))


def log_probability(p: Weights, h: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Natural log of the probability of symbols ``y`` after states ``h`` (of a tail's class, not of its word)."""
    classes, _, width = p.w.shape
    kind = np.where(y < words, y // width, y - words + classes).astype(np.uint16)
    order, cut = _by_class(kind, classes)
    order = order[: cut[-1]]
    rows = np.arange(_ROWS)
    out, own, more = np.empty(len(y)), h.take(order, axis=0), np.empty(len(order))
    at = y.take(order).astype(np.int64) - kind.take(order).astype(np.int64) * width

    def take(h: np.ndarray, w: np.ndarray, bias: np.ndarray, mass: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = h @ w
        got = a[rows[: len(a)], y] + bias.take(y)
        np.exp(a, out=a)
        return got - np.log(a @ mass)  # biases weigh the sum, and so are not added to each score

    mass = np.exp(p.bc)
    for s in range(0, len(y), _ROWS):
        part = slice(s, s + _ROWS)
        out[part] = take(h[part], p.c, p.bc, mass, kind[part])
    mass = np.exp(p.bw)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        for s in range(int(cut[k]), int(cut[k + 1]), _ROWS):
            part = slice(s, min(s + _ROWS, int(cut[k + 1])))
            more[part] = take(own[part], p.w[k], p.bw[k], mass[k], at[part])
    out[order] += more
    return out


class Lanes:
    """Texts dealt to lanes so that these are about equally long; of the same texts always the same."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, lanes: int, start: int):
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        lanes = max(1, min(lanes, len(order)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in order.tolist():
            n, k = heap[0]
            held[k].append(d)
            heapq.heapreplace(heap, (n + int(size[d]), k))
        length = np.array([int(size[x].sum()) if x else 0 for x in held])
        by_length = np.argsort(-length, kind="stable")
        docs = np.array([d for k in by_length for d in held[k]], dtype=np.int64)
        self.length = length[by_length]
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        n = size[docs]
        begin = np.concatenate([[0], np.cumsum(n)])
        source = np.repeat(first[docs] - begin[:-1], n) + np.arange(begin[-1])
        self.y = ids[source]
        self.doc = np.repeat(docs, n)
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.new = np.zeros(len(self.y), dtype=bool)
        self.new[begin[:-1]] = True
        self.x[self.new] = start

    def windows(self, steps: int):
        """Window by window: the lanes that go on, where their symbols lie (steps x lanes), and which of those exist."""
        longest = int(self.length[0]) if len(self.length) else 0
        for t in range(0, longest, steps):
            b = int(np.searchsorted(-self.length, -t, side="left"))
            here = t + np.arange(min(steps, longest - t))[:, None]
            ok = here < self.length[None, :b]
            yield b, np.where(ok, self.at[None, :b] + here, 0), ok


def _forward(u: np.ndarray, gate: Iterable[np.ndarray], h: np.ndarray, kept: np.ndarray, fresh: list[bool], states: np.ndarray, product: np.ndarray) -> np.ndarray:
    """States of a window, and the last; ``gate`` (of each step, gates x lanes) becomes update, reset and new state, ``product`` holds that of states and ``u``.

    A feature's lanes lie side by side, so that a gate of all lanes is one run of memory. Both have the logistic gates' sums with the
    other sign, as the exponential takes them; texts begin where ``kept`` is 0.
    """
    hidden = len(h)
    both = 2 * hidden
    changed = np.empty_like(states[0])
    with np.errstate(over="ignore"):  # a gate that is shut
        for at, g, to, new, keep in zip(gate, product, states, fresh, kept):
            if new:
                h = h * keep
            np.dot(u, h, out=g)
            a, m = at[:both], at[both:]
            a += g[:both]
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            np.multiply(g[both:], a[hidden:], out=changed)
            m += changed
            np.tanh(m, out=m)
            h = np.subtract(h, m, out=to)
            h *= a[:hidden]
            h += m
    return h


def _signed(v: np.ndarray, both: int) -> np.ndarray:
    v = v.copy()
    v[:, :both] *= -1
    return v


def _by_lane(v: np.ndarray) -> np.ndarray:
    """steps x lanes x features from steps x features x lanes, or back."""
    return np.ascontiguousarray(v.transpose(0, 2, 1))


def score(p: Weights, ids: np.ndarray, first: np.ndarray, words: int, lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Sum of :func:`log_probability` over each whole text; texts are ``ids[first[k]:first[k + 1]]``."""
    hidden = len(p.u)
    out = np.zeros(len(first) - 1)
    if not len(ids):
        return out
    run = Lanes(ids, first, lanes, len(p.x) - 1)
    from_symbol, u = _signed(p.x, 2 * hidden), np.ascontiguousarray(_signed(p.u, 2 * hidden).T)
    h = np.zeros((hidden, len(run.length)), dtype=np.float32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def add() -> None:
        if held:
            seen = np.concatenate([x[0] for x in held])
            states = np.concatenate([x[1] for x in held])
            out[:] += np.bincount(run.doc[seen], weights=log_probability(p, states, run.y[seen], words), minlength=len(out))
            held.clear()

    for b, where, ok in run.windows(steps):
        x, new = run.x.take(where), run.new.take(where)
        states = np.empty((len(where), hidden, b), dtype=np.float32)
        gate = (np.ascontiguousarray(from_symbol.take(at, axis=0).T) for at in x)
        h = _forward(u, gate, h[:, :b], (~new).astype(np.float32), new.any(axis=1).tolist(), states, repeat(np.empty((3 * hidden, b), dtype=np.float32)))
        held.append((where[ok], _by_lane(states)[ok]))
        size += len(held[-1][0])
        if size >= steps * lanes:
            add()
            size = 0
    add()
    return out


@dataclass
class _Words:
    """Where a window's words are multiplied: a block of ``_BLOCK`` rows of each class, then what these do not hold, class by class.

    ``source``: of each row, the state it holds (or the one after the last, which is zero); ``row``: that of each word, by class; ``hit``: a word's place
    among all scores; ``back``: of each symbol, its row (or the one after the last); ``further``: class, first and last row.
    """

    source: np.ndarray
    row: np.ndarray
    hit: np.ndarray
    back: np.ndarray
    further: list[tuple[int, int, int]]


def _place_words(window: np.ndarray, begin: np.ndarray, kind: np.ndarray, at: np.ndarray, classes: int, width: int, most: int) -> list[_Words]:
    """Of each window; ``window``: that of each symbol, ``begin``: the first of each and their number, ``kind``: its class (words: under ``classes``), ``at``: a word's place there; a window has ``most`` symbols at most."""
    windows = len(begin) - 1
    of = np.flatnonzero(kind < classes)
    key = window.take(of) * classes + kind.take(of)
    order = np.argsort(key.astype(np.uint16) if windows * classes <= 1 << 16 else key, kind="stable")
    of, key = of.take(order), key.take(order)
    n = np.bincount(key, minlength=windows * classes)
    place = np.arange(len(of)) - (np.cumsum(n) - n).take(key)
    more = np.maximum(n - _BLOCK, 0).reshape(windows, classes)
    first = classes * _BLOCK + np.cumsum(more, axis=1) - more
    row = np.where(place < _BLOCK, kind.take(of) * _BLOCK + place, first.ravel().take(key) + place - _BLOCK)
    rows = np.concatenate([[0], np.cumsum(classes * _BLOCK + more.sum(axis=1))])
    window = window.take(of)
    source = np.full(rows[-1], most)
    source[rows.take(window) + row] = of - begin.take(window)
    back = np.full(len(kind), classes * _BLOCK + most)
    back[of] = row
    hit = row * width + at.take(of)
    further: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
    w, k = np.nonzero(more)
    for i, c, s, e in zip(w.tolist(), k.tolist(), first[w, k].tolist(), (first + more)[w, k].tolist()):
        further[i].append((c, s, e))
    cut = np.concatenate([[0], np.cumsum(n.reshape(windows, classes).sum(axis=1))]).tolist()
    return [_Words(source[rows[i] : rows[i + 1]], row[cut[i] : cut[i + 1]], hit[cut[i] : cut[i + 1]], back[begin[i] : begin[i + 1]], further[i]) for i in range(windows)]


class _WordSlopes:
    """Slopes of the loss of words; holds the memory for windows of up to ``most`` symbols."""

    def __init__(self, classes: int, inputs: int, width: int, most: int):
        self.blocks = classes * _BLOCK
        total = self.blocks + most
        self.rows, self.a, self.back = (np.zeros((total + 1, n), dtype=np.float32) for n in (inputs, width, inputs))
        self.one, self.gw = np.ones(width, dtype=np.float32), np.empty((classes, inputs, width), dtype=np.float32)

    def __call__(self, s: np.ndarray, w: np.ndarray, p: _Words, share: np.float32) -> tuple[np.ndarray, np.ndarray]:
        """Slopes by states ``s``, whose last one is zero, of each symbol, and by ``w``; the next call takes their memory."""
        classes, inputs, width = w.shape
        n = len(p.source)
        rows, a, back, gw = self.rows[:n], self.a[:n], self.back[:n], self.gw
        blocks = lambda v: v[: self.blocks].reshape(classes, _BLOCK, v.shape[1])
        s.take(p.source, axis=0, out=rows, mode="clip")
        np.matmul(blocks(rows), w, out=blocks(a))
        for k, i, j in p.further:
            np.dot(rows[i:j], w[k], out=a[i:j])
        np.exp(a, out=a)
        mass = a @ self.one
        flat = a.reshape(-1)
        flat[p.hit] = flat.take(p.hit) - mass.take(p.row)
        np.matmul(blocks(a), w.transpose(0, 2, 1), out=blocks(back))
        by = np.divide(share, mass, out=mass)[:, None]
        rows *= by
        np.matmul(blocks(rows).transpose(0, 2, 1), blocks(a), out=gw)
        for k, i, j in p.further:
            np.dot(a[i:j], w[k].T, out=back[i:j])
            gw[k] += np.dot(rows[i:j].T, a[i:j])
        back *= by
        return self.back.take(p.back, axis=0), gw


def _word_slopes(s: np.ndarray, w: np.ndarray, kind: np.ndarray, at: np.ndarray, share: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the loss of words by states ``s`` and by ``w``; ``kind``: each word's class, ``at``: its place there."""
    n, (classes, inputs, width) = len(s), w.shape
    (p,) = _place_words(np.zeros(n, dtype=np.int64), np.array([0, n]), kind, at, classes, width, n)
    return _WordSlopes(classes, inputs, width, n)(np.concatenate([s, np.zeros((1, inputs), dtype=np.float32)]), w, p, share)


@dataclass
class _Sums:
    """How rows of the same symbol are added: laid side by side, filled up by zeros to a power of two, most first, and added in pairs.

    ``source``: of each place, its row (or the one after the last, which is zero); ``on``: after each halving, the places that are not
    yet one sum; ``symbols``: those of the sums.
    """

    source: np.ndarray
    on: list[int]
    symbols: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        a = rows.take(self.source, axis=0)
        done = []
        for k in self.on:
            done.append(a[k:])
            a = a[:k:2] + a[1:k:2]
        return np.concatenate([*done, a])


def _place_sums(window: np.ndarray, windows: int, symbol: np.ndarray, symbols: int, row: np.ndarray, most: int) -> list[_Sums]:
    """Of each window; ``window``, ``symbol`` and ``row`` are those of each symbol; a window has ``most`` rows at most."""
    key = window * symbols + symbol
    order = np.argsort(key.astype(np.uint16) if windows * symbols <= 1 << 16 else key, kind="stable")
    key, row = key.take(order), row.take(order)
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(heads, len(key)))
    halvings = np.ceil(np.log2(n)).astype(np.int64)
    key = key.take(heads)
    window, deepest = key // symbols, int(halvings.max()) + 1
    by_size = np.argsort(window * deepest - halvings, kind="stable")
    places = (1 << halvings).take(by_size)
    begin = np.empty(len(n), dtype=np.int64)
    begin[by_size] = np.cumsum(places) - places
    source = np.full(int(places.sum()), most)
    source[np.repeat(begin - heads, n) + np.arange(len(row))] = row
    count = np.bincount(window * deepest + halvings, minlength=windows * deepest).reshape(windows, deepest)
    held = count << np.arange(deepest)
    on = (np.cumsum(held[:, ::-1], axis=1)[:, ::-1] - held) >> np.arange(deepest)
    ends, sums = np.cumsum(held.sum(axis=1)).tolist(), np.cumsum(count.sum(axis=1)).tolist()
    out = (key % symbols).take(np.argsort(window * deepest + halvings, kind="stable"))
    return [_Sums(source[s:e], [k for k in ks if k], out[a:b]) for s, e, ks, a, b in zip([0, *ends], ends, on.tolist(), [0, *sums], sums)]


@dataclass
class _Window:
    """A window of training: inputs (steps x lanes), which texts go on, where symbols are (all: None), and the places that its sums and products need."""

    x: np.ndarray
    kept: np.ndarray
    fresh: list[bool]
    ok: np.ndarray | None
    size: int
    hit: np.ndarray
    words: _Words
    inputs: _Sums


def _windows(run: Lanes, steps: int, lanes: int, symbols: int, words: int, classes: int, width: int, outputs: int) -> Iterator[_Window]:
    """All windows; places are found for some windows at once, as many as 16 bits tell apart."""
    together = max(1, min(16, (1 << 16) // symbols))
    for b, where, ok in run.windows(steps * together):
        x, new = run.x.take(where), run.new.take(where)
        kept, fresh = (~new).astype(np.float32), new.any(axis=1).tolist()
        there = np.flatnonzero(ok)
        window = there // (b * steps)
        n = np.bincount(window)
        begin = np.concatenate([[0], np.cumsum(n)])
        row = np.arange(len(there)) - begin.take(window)
        alive = ok[::steps].sum(axis=1)
        grid = (there // b - window * steps) * alive.take(window) + there % b
        y = run.y.take(where.ravel().take(there)).astype(np.int64)
        kind = np.where(y < words, y // width, y - words + classes)
        hit = row * outputs + kind
        placed = _place_words(window, begin, kind, y % width, classes, width, steps * lanes)
        summed = _place_sums(window, len(n), x.ravel().take(there).astype(np.int64), symbols, grid, steps * lanes)
        for i, (s, e) in enumerate(pairwise(begin.tolist())):
            t = slice(i * steps, (i + 1) * steps)
            here = ok[t, : alive[i]]
            yield _Window(x[t, : alive[i]], kept[t, : alive[i]], fresh[t], None if e - s == here.size else here.ravel(), e - s, hit[s:e], placed[i], summed[i])


def train(p: Weights, ids: np.ndarray, first: np.ndarray, words: int, lanes: int = 64, steps: int = 16, rate: float = 0.2) -> Weights:
    """One pass of truncated backpropagation through time with Adagrad steps, a step each window.

    What does not wait for the step before is taken for a whole window at once, in arrays of steps x features x lanes.
    """
    hidden, (classes, _, width) = len(p.u), p.w.shape
    gates, both = 3 * hidden, 2 * hidden
    p = p.like(p.flat())
    if not len(ids):
        return p
    # an output's bias is the last of its weights, which a state's last place, a one, picks; the logistic gates' sums have the other sign
    now = {"x": _signed(p.x, both), "u": _signed(p.u, both), "c": np.concatenate([p.c.T, p.bc[:, None]], axis=1), "w": np.concatenate([p.w, p.bw[:, None]], axis=1)}
    seen = {name: np.full_like(v, 1e-5) for name, v in now.items()}

    def move(name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        s = grad * grad
        if rows is None:
            seen[name] += s
            np.sqrt(seen[name], out=s)
        else:
            s += seen[name].take(rows, axis=0)
            seen[name][rows] = s
            np.sqrt(s, out=s)
        np.divide(grad, s, out=s)
        s *= rate
        if rows is None:
            now[name] -= s
        else:
            now[name][rows] = now[name].take(rows, axis=0) - s

    run = Lanes(ids, first, lanes, len(p.x) - 1)
    lanes, outputs = len(run.length), len(now["c"])
    h = np.zeros((hidden, lanes), dtype=np.float32)
    one = np.ones(outputs, dtype=np.float32)
    held = np.zeros((steps * lanes + 1, hidden + 1), dtype=np.float32)  # states and a one; at last zeros
    held[:-1, hidden] = 1
    scores, into_gates = np.empty((steps * lanes, outputs), dtype=np.float32), np.zeros((steps * lanes + 1, gates), dtype=np.float32)
    word_slopes = _WordSlopes(classes, hidden + 1, width, steps * lanes)
    through = np.concatenate([now["u"], np.eye(hidden, dtype=np.float32)], axis=1)
    for v in _windows(run, steps, lanes, len(p.x), words, classes, width, outputs):
        n_steps, b = v.x.shape
        gate = _by_lane(now["x"].take(v.x, axis=0))  # from the symbols; becomes update, reset and new state
        states, product = np.empty((n_steps + 1, hidden, b), dtype=np.float32), np.empty((n_steps, gates, b), dtype=np.float32)
        states[0] = h[:, :b]
        h = _forward(np.ascontiguousarray(now["u"].T), gate, states[0], v.kept, v.fresh, states[1:], product)
        before = states[:-1] * v.kept[:, None]
        by_lane = states[1:].transpose(0, 2, 1)
        if v.ok is None:
            held[: v.size, :hidden].reshape(n_steps, b, hidden)[:] = by_lane
        else:
            held[: v.size, :hidden] = by_lane.reshape(-1, hidden)[v.ok]
        s, a = held[: v.size], scores[: v.size]
        share = np.float32(1 / v.size)
        np.dot(s, now["c"].T, out=a)
        np.exp(a, out=a)
        mass = a @ one
        flat = a.reshape(-1)
        flat[v.hit] = flat.take(v.hit) - mass
        by = np.divide(share, mass, out=mass)[:, None]  # scales what is made of a, which is larger
        ds = a @ now["c"]
        ds *= by
        gc = a.T @ (s * by)
        gw = None
        if len(v.words.row):
            back, gw = word_slopes(held, now["w"], v.words, share)
            ds += back
        if v.ok is not None:
            whole = np.zeros((n_steps * b, hidden + 1), dtype=np.float32)
            whole[v.ok] = ds
            ds = whole
        into = _by_lane(ds.reshape(n_steps, b, hidden + 1)[:, :, :hidden])  # becomes what reaches each state
        z, r, n = gate[:, :hidden], gate[:, hidden:both], gate[:, both:]
        by = np.empty((n_steps, 4, hidden, b), dtype=np.float32)  # of update, of reset, of state, and what goes by it
        by[:, 3] = z
        rest = 1 - z
        by_new = n * n
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        rest *= z
        np.subtract(n, before, out=by[:, 0])
        by[:, 0] *= rest
        np.multiply(by_new, r, out=by[:, 2])
        np.subtract(r, 1, out=rest)
        rest *= product[:, both:]
        np.multiply(by[:, 2], rest, out=by[:, 1])
        dg, dh = np.empty((n_steps, 4, hidden, b), dtype=np.float32), np.zeros((hidden, b), dtype=np.float32)
        through[:, :gates] = now["u"]
        for t in range(n_steps - 1, -1, -1):
            at = into[t]
            at += dh
            np.multiply(by[t], at, out=dg[t])
            np.dot(through, dg[t].reshape(-1, b), out=dh)
            if v.fresh[t]:
                dh *= v.kept[t]
        dg = dg.reshape(n_steps, -1, b)[:, :gates]
        du = np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
        np.multiply(into, by_new, out=dg[:, both:])
        into_gates[: n_steps * b].reshape(n_steps, b, gates)[:] = dg.transpose(0, 2, 1)
        move("u", np.minimum(np.maximum(du, -0.1), 0.1))
        move("x", v.inputs(into_gates), v.inputs.symbols)
        move("c", gc)
        if gw is not None:
            move("w", gw)
    return Weights(_signed(now["x"], both), _signed(now["u"], both), now["c"][:, :-1].T.copy(), now["c"][:, -1].copy(), now["w"][:, :-1].copy(), now["w"][:, -1].copy())

