"""A recurrent risk model over the steps of a session: layer norm, stacked LSTM cells and a logistic output, in batches of matrix products.

Weights are a table (name, shape, values), so a fitted model is written and read like any other table. All sequences of a batch take their k-th
step together; a sequence that is shorter keeps its state. Fitting (:func:`fit`) is truncated to the window that is scored, on a
bounded sample of windows, which the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
EPSILON = 1e-5


def start(inputs: int, hidden: int, layers: int, seed: int = 3) -> Weights:
    """Small random weights; states are kept at first (forget gates open)."""
    r = np.random.default_rng(seed)
    out: Weights = {"norm_scale": np.ones(inputs), "norm_shift": np.zeros(inputs), "out_w": r.standard_normal(hidden) / np.sqrt(hidden), "out_b": np.zeros(1)}
    for n in range(layers):
        size = inputs if n == 0 else hidden
        out[f"x{n}"] = r.standard_normal((size, 4 * hidden)) / np.sqrt(size)
        out[f"h{n}"] = r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
        out[f"b{n}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    return out


def to_table(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in weights.items()], "name string, shape array<int>, `values` array<double>")


def from_table(table: DataFrame) -> Weights:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in table.collect()}  # the model, whose size is fixed


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=-1, keepdims=True)
    deviation = np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + EPSILON)
    return (x - mean) / deviation, deviation


def _layers(w: Weights) -> int:
    return sum(1 for k in w if k[0] == "x")


def forward(w: Weights, x: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Probabilities of padded sequences (sequences x steps x inputs) of so many steps, and what backpropagation needs."""
    normed, _ = _norm(x)
    below = normed * w["norm_scale"] + w["norm_shift"]
    many, steps, _ = x.shape
    kept = []
    live = np.arange(steps)[None, :] < size[:, None]
    for n in range(_layers(w)):
        hidden = len(w[f"h{n}"])
        h, c = np.zeros((many, hidden)), np.zeros((many, hidden))
        above = np.zeros((many, steps, hidden))
        for t in range(steps):
            a = below[:, t] @ w[f"x{n}"] + h @ w[f"h{n}"] + w[f"b{n}"]
            i, f, o = (_sigmoid(a[:, k * hidden : (k + 1) * hidden]) for k in (0, 1, 3))
            g = np.tanh(a[:, 2 * hidden : 3 * hidden])
            on = live[:, t, None]
            c2 = np.where(on, f * c + i * g, c)
            h2 = np.where(on, o * np.tanh(c2), h)
            if keep:
                kept.append((below[:, t], h, c, i, f, g, o, c2, on))
            h, c = h2, c2
            above[:, t] = h
        below = above
    p = _sigmoid(h @ w["out_w"] + w["out_b"])
    return p, [normed, h, kept]


def _backward(w: Weights, x: np.ndarray, p: np.ndarray, y: np.ndarray, kept: list) -> Weights:
    """Gradients of the mean log loss."""
    normed, last, steps_kept = kept
    many, steps, _ = x.shape
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    d = (p - y) / many
    grads["out_w"], grads["out_b"] = last.T @ d, np.array([d.sum()])
    dabove = np.zeros((many, steps, len(w["out_w"])))
    dlast = d[:, None] * w["out_w"]
    for n in range(_layers(w) - 1, -1, -1):
        hidden = len(w[f"h{n}"])
        dbelow = np.zeros((many, steps, len(w[f"x{n}"])))
        dh = dlast if n == _layers(w) - 1 else np.zeros((many, hidden))
        dc = np.zeros((many, hidden))
        for t in range(steps - 1, -1, -1):
            below, h, c, i, f, g, o, c2, on = steps_kept[n * steps + t]
            dh = dh + dabove[:, t]
            live = np.where(on, dh, 0)
            tanh = np.tanh(c2)
            dcell = np.where(on, dc, 0) + live * o * (1 - tanh**2)
            da = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dcell * i * (1 - g**2), live * tanh * o * (1 - o)], axis=1)
            grads[f"x{n}"] += below.T @ da
            grads[f"h{n}"] += h.T @ da
            grads[f"b{n}"] += da.sum(axis=0)
            dbelow[:, t] = da @ w[f"x{n}"].T
            dh = np.where(on, da @ w[f"h{n}"].T, dh)
            dc = np.where(on, dcell * f, dc)
        dabove = dbelow
    grads["norm_scale"] = (dabove * normed).sum(axis=(0, 1))
    grads["norm_shift"] = dabove.sum(axis=(0, 1))
    return grads


def train(w: Weights, x: np.ndarray, size: np.ndarray, y: np.ndarray, passes: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Weights:
    """Adam on batches in a fixed random order."""
    r = np.random.default_rng(seed)
    w = {k: v.astype(np.float64).copy() for k, v in w.items()}
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(passes):
        order = r.permutation(len(y))
        for s in range(0, len(y), batch):
            rows = order[s : s + batch]
            p, kept = forward(w, x[rows], size[rows], keep=True)
            t += 1
            for k, g in _backward(w, x[rows], p, y[rows], kept).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def padded(sequences: pa.Array, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """A list array of lists of numbers as one dense array, and the length of each sequence."""
    offsets = sequences.offsets.to_numpy()
    size = np.diff(offsets)
    flat = sequences.values.slice(offsets[0], offsets[-1] - offsets[0])
    numbers = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
    out = np.zeros((len(size), max(1, int(size.max(initial=0))), inputs))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = numbers
    return out, size


def fit(windows: DataFrame, sequence: str, label: str, key: list[str], hidden: int = 16, layers: int = 2, sample: int = 4000, **options) -> Weights:
    """Weights fitted to ``label`` (0 or 1) of windows of feature rows; the ``sample`` windows with the smallest hashes of their key are used (a documented bound)."""
    some = windows.where(F.col(label).isNotNull()).select(F.col(sequence).alias("s"), F.col(label).cast("double").alias("y"), *key)
    table = some.orderBy(F.xxhash64(*key), *key).limit(sample).select("s", "y").toArrow()
    if not len(table):
        return start(1, hidden, layers)
    first = table["s"].combine_chunks()
    inputs = len(first[0].as_py()[0])
    x, size = padded(first, inputs)
    return train(start(inputs, hidden, layers), x, size, table["y"].to_numpy(), **options)


def score(df: DataFrame, sequence: str, weights: Weights, into: str = "probability") -> DataFrame:
    """Adds the model's probability of each window; the weights go to all workers (their number is fixed)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    inputs = len(weights["norm_scale"])
    columns = [c for c in df.columns if c != sequence]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x, size = padded(batch.column(sequence), inputs)
            p = forward(w, x, size)[0] if len(size) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(p)], names=[*columns, into])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{into}` double")
