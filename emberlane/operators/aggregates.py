"""User-defined aggregates in two phases: a partial state for each key and batch of rows, merged by key in a tree.

An aggregate is three functions on columns: rows to a state, states to a state, a state to a value. What travels is states only; a key that
holds most rows sends one state for each batch of them, and states meet about ``fan`` at a time, so no task holds a key's rows or all its states.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.sources.tables import written

State = dict[str, np.ndarray]


class Aggregate(ABC):
    """``result`` is the DDL of a struct's fields; states are columns of doubles, whatever their lengths."""

    result: str

    @abstractmethod
    def partial(self, values: np.ndarray) -> State:
        """The state of some values (without nulls, one at least)."""

    @abstractmethod
    def merge(self, states: list[State]) -> State:
        """One state for several, in any grouping."""

    @abstractmethod
    def finish(self, state: State) -> dict:
        """The fields of the result."""


class Moments(Aggregate):
    """Count, mean and variance, by pairwise merging of means and squared deviations."""

    result = "n bigint, mean double, variance double"

    def partial(self, values: np.ndarray) -> State:
        mean = values.mean()
        return {"n": np.array([len(values)]), "mean": np.array([mean]), "m2": np.array([((values - mean) ** 2).sum()])}

    def merge(self, states: list[State]) -> State:
        n, mean, m2 = (np.concatenate([s[k] for s in states]) for k in ("n", "mean", "m2"))
        total = n.sum()
        whole = (n * mean).sum() / total
        return {"n": np.array([total]), "mean": np.array([whole]), "m2": np.array([m2.sum() + (n * (mean - whole) ** 2).sum()])}

    def finish(self, state: State) -> dict:
        n = int(state["n"][0])
        return {"n": n, "mean": float(state["mean"][0]), "variance": float(state["m2"][0] / (n - 1)) if n > 1 else None}


class Quantiles(Aggregate):
    """Quantiles at ``at`` from a summary of ``size`` weighted values.

    A state is compressed to ``size`` values, each standing for an equal share of the weight, which moves ranks by at most half a share;
    ``error`` in the state adds up what all compressions on the way have moved. The result's ``error`` bounds how far, as a share of all
    values, the rank of each quantile may be off.
    """

    def __init__(self, at: tuple[float, ...], size: int = 1024):
        self.at, self.size = at, size
        self.result = "n bigint, quantiles array<double>, error double"

    def _compress(self, value: np.ndarray, weight: np.ndarray, error: float) -> State:
        order = np.argsort(value, kind="stable")
        value, weight = value[order], weight[order]
        if len(value) > self.size:
            share = weight.sum() / self.size
            upto = np.cumsum(weight)
            value = value[np.minimum(np.searchsorted(upto, (np.arange(self.size) + 0.5) * share), len(value) - 1)]
            weight, error = np.full(self.size, share), error + share / 2
        return {"value": value, "weight": weight, "error": np.array([error])}

    def partial(self, values: np.ndarray) -> State:
        return self._compress(values, np.ones(len(values)), 0.0)

    def merge(self, states: list[State]) -> State:
        # errors of parts add up: each may have moved every rank
        return self._compress(*(np.concatenate([s[k] for s in states]) for k in ("value", "weight")), sum(float(s["error"][0]) for s in states))

    def finish(self, state: State) -> dict:
        upto = np.cumsum(state["weight"])
        n = upto[-1]
        rank = np.minimum(np.searchsorted(upto, np.array(self.at) * n - 1e-9), len(upto) - 1)
        step = float(state["weight"].max())
        return {"n": int(round(n)), "quantiles": state["value"][rank].tolist(), "error": (float(state["error"][0]) + step) / n}


class HeavyHitters(Aggregate):
    """The commonest whole numbers (or hashes below 2**53) by counters of which ``size`` are kept (Misra and Gries).

    Counts are low by at most ``error``, the sum of what was taken from all counters, which is at most n / (size + 1): no value that
    occurs more often is missing. ``top`` values are reported.
    """

    def __init__(self, size: int = 256, top: int = 10):
        self.size, self.top = size, top
        self.result = "n bigint, values array<bigint>, counts array<bigint>, error bigint"

    def _cut(self, value: np.ndarray, count: np.ndarray, n: float, error: float) -> State:
        value, at = np.unique(value, return_inverse=True)
        count = np.bincount(at, weights=count)
        if len(value) > self.size:
            take = np.sort(count)[-self.size - 1]
            value, count, error = value[count > take], count[count > take] - take, error + take
        return {"value": value.astype(np.float64), "count": count, "n": np.array([n]), "error": np.array([error])}

    def partial(self, values: np.ndarray) -> State:
        return self._cut(values, np.ones(len(values)), len(values), 0.0)

    def merge(self, states: list[State]) -> State:
        join = lambda k: np.concatenate([s[k] for s in states])
        return self._cut(join("value"), join("count"), join("n").sum(), join("error").sum())

    def finish(self, state: State) -> dict:
        order = np.lexsort((state["value"], -state["count"]))[: self.top]
        return {"n": int(state["n"][0]), "values": state["value"][order].astype(np.int64).tolist(), "counts": state["count"][order].astype(np.int64).tolist(), "error": int(state["error"][0])}


_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def _pack(state: State) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([(k, pa.list_(pa.float64())) for k in state])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([np.asarray(v, dtype=np.float64)], pa.list_(pa.float64())) for v in state.values()], names=list(state)))
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> State:
    table = pa.ipc.open_stream(raw).read_all()
    return {k: table[k].combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in table.column_names}


def aggregate(df: DataFrame, by: list[str], value: str, how: Aggregate, fan: int = 32) -> DataFrame:
    """A row for each key (null is one) with the fields of the result; keys without a value that is not null have none."""
    keys = [f"_k{k}" for k in range(len(by))]
    kinds = ", ".join(f"{k} {t}" for k, t in df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]).dtypes)
    head = kinds + ", " if kinds else ""
    fields = [f.split() for f in how.result.split(", ")]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            table = pa.Table.from_batches([batch])
            if keys:
                groups = table.append_column("_row", pa.array(np.arange(len(table)))).group_by(keys).aggregate([("_row", "list")])
                rows = [x.values.to_numpy() for x in groups["_row_list"]]
                named = groups.select(keys)
            else:
                rows, named = [np.arange(len(table))], None
            values = table["_v"].to_numpy()
            states = [_pack(how.partial(values[r])) for r in rows]
            columns = [*([named[k].combine_chunks() for k in keys] if keys else []), pa.array([part * 1_000_003 + n] * len(states), pa.int64()), pa.array(states, pa.binary())]
            if states and len(table):
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_group", "_state"])

    def merge(table: pa.Table) -> pa.Table:
        state = how.merge([_unpack(x) for x in table["_state"].to_pylist()]) if len(table) > 1 else None
        out = table.slice(0, 1)
        return out if state is None else out.set_column(out.schema.get_field_index("_state"), "_state", pa.array([_pack(state)], pa.binary()))

    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").cast("double").alias("_v")).where("_v IS NOT NULL")
    states = rows.mapInArrow(partials, f"{head}_group long, _state binary")
    while True:  # a level of the tree for each power of ``fan``
        states = written(states, "states")
        most = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        group = F.pmod(F.xxhash64("_group"), F.lit(-(-most // fan))) if most > fan else F.lit(0).cast("long")
        states = states.withColumn("_group", group).groupBy(*keys, "_group").applyInArrow(merge, f"{head}_group long, _state binary")
        if most <= fan:
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [how.finish(_unpack(x)) for x in batch.column("_state").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array([m[n] for m in made], _KINDS[t]) for n, t in fields]], names=[*keys, *[n for n, _ in fields]])

    out = states.mapInArrow(finish, head + ", ".join(f"`{n}` {t}" for n, t in fields))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *[n for n, _ in fields])
