"""Running sums over a whole order, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm.scratch import materialize


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], name: str, within: str | None = None) -> DataFrame:
    """``df`` with inclusive running sums in ``order``: ``sums`` maps new columns to columns of longs.

    The rows are sorted by ranges; each task sums its own range, and what the ranges before it add is one row a range, which
    the driver adds up and sends to all. With ``within`` (which must lead the order) sums start anew where that column of
    longs changes, however many ranges one value takes. The sorted table is written, so that the ranges stay as they are.
    """
    columns, news = df.columns, list(sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, first, seen, carry = None, True, 0, np.zeros(len(news), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(within).to_numpy() if within else np.zeros(n, dtype=np.int64)
            new = np.ones(n, dtype=bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is not None and key[0] != last
            run = np.cumsum(new)
            starts = np.flatnonzero(new)
            out = []
            for k, c in enumerate(sums.values()):
                v = batch.column(c).to_numpy().astype(np.int64)
                total = np.cumsum(v)
                before = np.concatenate([[-carry[k]], total[starts] - v[starts]])
                out.append(total - before[run])
                carry[k] = out[-1][-1]
            whole = first & (run == 0)
            first, last = bool(whole[-1]), key[-1]
            at = np.arange(seen, seen + n, dtype=np.int64)
            seen += n
            more = [pa.array(x) for x in out] + [pa.array(np.full(n, part, np.int64)), pa.array(at), pa.array(whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *news, "_part", "_at", "_first"])

    schema = ", ".join(f"`{c}` {k}" for c, k in [*df.dtypes, *((c, "bigint") for c in news), ("_part", "bigint"), ("_at", "bigint"), ("_first", "boolean")])
    table = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema), name)
    key = F.col(within) if within else F.lit(0).cast("long")
    found = table.groupBy("_part").agg(F.min_by(key, "_at").alias("a"), F.max_by(F.struct(key.alias("b"), "_first", *news), "_at").alias("z")).orderBy("_part").collect()  # one row a range
    carry, open_key, add = [], None, [0] * len(news)
    for r in found:
        if r["a"] != open_key:
            add = [0] * len(news)
        carry.append((r["_part"], *add))
        add = [x + (y if r["z"]["_first"] else 0) for x, y in zip((r["z"][c] for c in news), add)]
        open_key = r["z"]["b"]
    side = df.sparkSession.createDataFrame(carry, "_part long, " + ", ".join(f"`_{c}` long" for c in news))
    out = table.join(F.broadcast(side), "_part")
    return out.select(*columns, *[F.when(F.col("_first"), F.col(c) + F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in news])
