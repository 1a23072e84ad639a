"""Parallel prefix: what a fold over an ordered group gives at each row, without a task that sees the whole group.

A fold whose steps compose (each step is a function of the state, and two steps after one another are a function of the same
kind) needs no order of evaluation, only an order of rows. The rows are sorted by ranges of (group, order), whatever the number of groups;
each task composes the steps of its own range with vectorised doubling, the driver composes one row a range, and what stands
before a range is applied to it. A group may so take up any number of ranges.

The sorted rows are written, so that ranges stay as they are; a lost executor costs a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.sources.tables import written

Steps = dict[str, np.ndarray]


@dataclass(frozen=True)
class Monoid:
    """Steps as columns of doubles: their names, the step that changes nothing, and how a left step is followed by a right one."""

    names: tuple[str, ...]
    neutral: tuple[float, ...]
    then: Callable[[Steps, Steps], Steps]


def _sums(left: Steps, right: Steps) -> Steps:
    return {k: left[k] + right[k] for k in right}


def sums(*names: str) -> Monoid:
    return Monoid(names, (0.0,) * len(names), _sums)


def _affine(left: Steps, right: Steps) -> Steps:
    return {"m": left["m"] * right["m"], "c": right["m"] * left["c"] + right["c"]}


#: ``t -> m * t + c``, as of an exponential mean.
AFFINE = Monoid(("m", "c"), (1.0, 0.0), _affine)


def _clamped(left: Steps, right: Steps) -> Steps:
    fit = lambda v: np.minimum(np.maximum(v + right["a"], right["lo"]), right["hi"])
    return {"a": left["a"] + right["a"], "lo": fit(left["lo"]), "hi": fit(left["hi"])}


#: ``t -> min(max(t + a, lo), hi)``.
CLAMPED = Monoid(("a", "lo", "hi"), (0.0, -np.inf, np.inf), _clamped)


def machine(states: int) -> Monoid:
    """A finite machine that moves a clamped value: of each state ``s`` the next state ``to_s`` and the move ``a_s, lo_s, hi_s``."""

    def then(left: Steps, right: Steps) -> Steps:
        ends = {k: np.stack([right[f"{k}_{s}"] for s in range(states)]) for k in ("to", "a", "lo", "hi")}
        out = {}
        for s in range(states):
            mid = left[f"to_{s}"].astype(np.int64)
            pick = {k: np.take_along_axis(v, mid[None], axis=0)[0] for k, v in ends.items()}
            moved = _clamped({k: left[f"{k}_{s}"] for k in ("a", "lo", "hi")}, pick)
            out |= {f"to_{s}": pick["to"]} | {f"{k}_{s}": v for k, v in moved.items()}
        return out

    names = tuple(f"{k}_{s}" for s in range(states) for k in ("to", "a", "lo", "hi"))
    return Monoid(names, tuple(x for s in range(states) for x in (float(s), 0.0, -np.inf, np.inf)), then)


def _take(steps: Steps, at) -> Steps:
    return {k: v[at] for k, v in steps.items()}


def doubled(monoid: Monoid, steps: Steps, start: np.ndarray) -> Steps:
    """Each row's composition of the steps from ``start`` (the row where its run begins) to itself."""
    n = len(start)
    steps = {k: steps[k].astype(np.float64) for k in monoid.names}
    at, d = np.arange(n), 1
    while True:
        rows = np.flatnonzero(at - d >= start)
        if not len(rows):
            return steps
        new = monoid.then(_take(steps, rows - d), _take(steps, rows))
        for k in monoid.names:
            steps[k] = steps[k].copy()
            steps[k][rows] = new[k]
        d *= 2


def prefix(df: DataFrame, key: list[str], order: list[Column], monoid: Monoid, name: str = "prefix") -> DataFrame:
    """``df``, whose columns named as the monoid's hold each row's step, with the composition of all steps of the row's group up to it."""
    columns, names = df.columns, monoid.names

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, first = TaskContext.get().partitionId(), 0, None, True
        carry: Steps = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = batch.column("_px_group").to_numpy()
            new = np.ones(n, dtype=bool)
            new[1:] = group[1:] != group[:-1]
            goes_on = last is not None and group[0] == last
            run = np.cumsum(new) - 1
            start = np.flatnonzero(new)[run]
            steps = doubled(monoid, {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}, start)
            if goes_on:
                head = np.flatnonzero(run == 0)
                joined = monoid.then({k: np.repeat(carry[k], len(head)) for k in names}, _take(steps, head))
                for k in names:
                    steps[k][head] = joined[k]
            whole = (run == 0) & first & (goes_on or last is None)
            first, last, carry = bool(whole[-1]), group[-1], _take(steps, slice(n - 1, n))
            extra = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seen, seen + n, dtype=np.int64)), pa.array(whole)]
            seen += n
            arrays = [pa.array(steps[c]) if c in names else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("_px_group"), *extra], names=[*columns, "_px_group", "_px_part", "_px_at", "_px_first"])

    kinds = {c: "double" if c in names else k for c, k in df.dtypes}
    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds.items(), ("_px_group", "bigint"), ("_px_part", "bigint"), ("_px_at", "bigint"), ("_px_first", "boolean")])
    by = [F.col(f"`{k}`") for k in key]
    dealt = df.withColumn("_px_group", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    table = written(dealt.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(local, schema), name)
    found = table.groupBy("_px_part").agg(F.min_by("_px_group", "_px_at").alias("a"), F.max_by(F.struct("_px_group", "_px_first", *names), "_px_at").alias("z")).orderBy("_px_part").collect()  # one row a range
    neutral = {k: np.array([v]) for k, v in zip(names, monoid.neutral)}
    before, open_group, rows = neutral, None, []
    for r in found:
        if r["a"] != open_group:
            before = neutral
        rows.append((r["_px_part"], *(float(before[k][0]) for k in names)))
        end = {k: np.array([r["z"][k]]) for k in names}
        before = monoid.then(before, end) if r["z"]["_px_first"] else end
        open_group = r["z"]["_px_group"]
    if not rows:
        return table.select(*columns)
    side = df.sparkSession.createDataFrame(rows, "_px_part long, " + ", ".join(f"`_b_{k}` double" for k in names))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = {k: batch.column(k).to_numpy() for k in names}
            out = monoid.then({k: batch.column(f"_b_{k}").to_numpy() for k in names}, right)
            whole = batch.column("_px_first").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(whole, out[c], right[c])) if c in names else batch.column(c) for c in columns], names=columns)

    joined = table.join(F.broadcast(side), "_px_part")  # one row a range
    return joined.mapInArrow(apply, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
