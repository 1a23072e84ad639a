"""Texts as vectors, and the nearest of many anchors by an inverted file.

Encoder. A text's character trigrams (of the lower-case text) are counted in hashed buckets, damped by a logarithm, weighted by how rare a
bucket is (fitted on a table) and projected to ``dims`` numbers by fixed random signs; vectors have length one.

Index. Centroids are fitted by spherical k-means on a bounded sample of the anchors (``sample`` rows with the smallest hashes of
their id, a documented bound); every anchor goes to the list of its nearest centroid. A query visits the ``probes`` lists nearest to it. Lists and
visits meet by a shuffle on (list, block, part): long lists are cut into blocks of ``block`` anchors and visits of a list into parts, so
no task holds a list or its queries. With as many probes as lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.sources.tables import written

BUCKETS = 1 << 15
#: Visits that a task makes at once.
VISITS = 1 << 14


def _trigrams(text: str) -> np.ndarray:
    """Hashed buckets of a text's character trigrams, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


@dataclass
class Encoder:
    """Weights of the buckets, and the seed of their random signs."""

    weight: np.ndarray
    dims: int
    seed: int = 11

    def signs(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, self.dims)) / np.float32(np.sqrt(self.dims))

    def encode(self, texts: list[str | None], signs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for k, text in enumerate(texts):
            bucket, n = np.unique(_trigrams(text or ""), return_counts=True)
            out[k] = (np.log1p(n) * self.weight[bucket]).astype(np.float32) @ signs[bucket]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def fit_encoder(df: DataFrame, text: str, dims: int = 64) -> Encoder:
    """Bucket weights by how many of the table's texts hold one; the driver gets a number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held[np.unique(_trigrams(x or ""))] += 1
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["bucket", "n"])

    rows = df.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    held = np.zeros(BUCKETS)
    held[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return Encoder(np.log((1 + df.count()) / (1 + held)) + 1, dims)


def encode(df: DataFrame, text: str, encoder: Encoder, into: str = "vector") -> DataFrame:
    """Adds the vector of a text; that of a text under three characters is all zeros."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        signs = encoder.signs()
        for batch in batches:
            made = encoder.encode(batch.column(columns.index(text)).to_pylist(), signs)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(made)], names=[*columns, into])

    return df.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{into}` array<float>")


def _lists(rows: np.ndarray) -> pa.Array:
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(rows.ravel().astype(np.float32), pa.float32()))


def _dense(column, dims: int) -> np.ndarray:
    """A list column as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def centroids(anchors: DataFrame, key: str, vector: str, lists: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on the sample; an empty list keeps its centroid."""
    some = anchors.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.xxhash64("k"), "k").limit(sample).toArrow()
    dims = len(some["v"][0].as_py())
    x = _dense(some["v"], dims)
    c = x[np.random.default_rng(5).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-12), c)
    return c


def nearest(queries: DataFrame, anchors: DataFrame, query: str, anchor: str, vector: str, lists: int | None = None, probes: int = 8, block: int = 4096, part: int = 8192) -> DataFrame:
    """``query, anchor, similarity``: of each query row the anchor of the greatest cosine (of equals the smallest); a query is its id's row."""
    anchors = written(anchors.select(F.col(anchor).alias("_a"), F.col(vector).cast("array<double>").alias("_v")).where(F.size(vector) > 0), "anchors")
    n = anchors.count()
    kinds = dict(queries.dtypes)[query], dict(anchors.dtypes)["_a"]
    schema = f"`{query}` {kinds[0]}, `{anchor}` {kinds[1]}, similarity double"
    if not n:
        return queries.select(query, F.lit(None).cast(kinds[1]).alias(anchor), F.lit(None).cast("double").alias("similarity")).limit(0)
    lists = lists or max(1, int(np.sqrt(n)))
    if probes >= lists:  # all would be visited: one list, whose blocks every query meets, says the same without a copy for each list
        lists = probes = 1
    shared = queries.sparkSession.sparkContext.broadcast(centroids(anchors, "_a", "_v", lists))
    probes = min(probes, len(shared.value))

    def visits(take: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, step = shared.value, max(1, VISITS // take)
            for batch in (b.slice(s, step) for b in batches for s in range(0, b.num_rows, step)):
                near = _dense(batch.column(1), c.shape[1]) @ c.T
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                rows = np.repeat(np.arange(len(batch)), take)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(best.ravel().astype(np.int64))], names=names)

        return run

    filed = written(anchors.mapInArrow(visits(1, ["_a", "_v", "_list"]), f"_a {kinds[1]}, _v array<double>, _list long"), "filed")
    asked = queries.select(F.col(query).alias("_q"), F.col(vector).cast("array<double>").alias("_w")).where(F.size(vector) > 0)
    asked = written(asked.mapInArrow(visits(probes, ["_q", "_w", "_list"]), f"_q {kinds[0]}, _w array<double>, _list long"), "asked")
    # long lists and many visits are cut; each part of a list's visits meets each of its blocks
    sizes = filed.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")).join(asked.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts")), "_list")
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    side = F.broadcast(sizes)  # a row a list
    left = filed.join(side, "_list").withColumn("_block", F.pmod(F.xxhash64("_a"), F.col("_blocks"))).withColumn("_part", spread("_parts")).select("_list", "_block", "_part", "_a", "_v")
    right = asked.join(side, "_list").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts"))).withColumn("_block", spread("_blocks")).select("_list", "_block", "_part", "_q", "_w")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"_q": right["_q"].slice(0, 0), "_a": left["_a"].slice(0, 0), "_s": pa.array([], pa.float64())})
        left = left.sort_by("_a")
        dims = len(left["_v"][0])
        v, best, at = _dense(left["_v"], dims), [], []
        w = _dense(right["_w"], dims)
        for s in range(0, len(w), 1024):
            near = w[s : s + 1024] @ v.T
            at.append(near.argmax(axis=1))
            best.append(near.max(axis=1))
        return pa.table({"_q": right["_q"], "_a": left["_a"].take(pa.array(np.concatenate(at))), "_s": pa.array(np.concatenate(best).astype(np.float64))})

    by = ("_list", "_block", "_part")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"_q {kinds[0]}, _a {kinds[1]}, _s double")
    top = found.groupBy("_q").agg(F.max("_s").alias("similarity"), F.min_by("_a", F.struct(-F.col("_s"), F.col("_a"))).alias("_a"))
    return top.select(F.col("_q").alias(query), F.col("_a").alias(anchor), "similarity")
