"""Near-dedup by SimHash and the Jaccard similarity of word shingles: the pipeline's third stage.

Method. A text is the set of its runs of five words (lower-cased, hashed to 64 bits). Two texts are linked
if their sets' similarity is 0.8 or more. Candidates are those of the SimHash operator: fingerprints of the sets
within three bits, found by the pigeonring (:func:`emberlane.llm.simhash.near_links`). At 0.8 some ten bits differ, and a radius
of 16 or more would make the pigeonring's first segment too short a key for a large table, so more candidates come
from MinHash: ``BANDS`` keys of ``ROWS`` minima
each; a pair of similarity s shares a key with probability 1 - (1 - s^6)^40, above 0.99999 at 0.8, and
one of 0.3 with 0.03. Texts
with a common key are first joined to the smallest of them, and the components of these joins and of the SimHash links are groups
of candidates; in a group every pair with a common key or near fingerprints is compared by its whole sets, unless both texts
are in the same component already. Equal sets are one entry, so copies cost nothing. A group of more than
``most`` sets is no single task's: sets are compared with the one that leads most of their keys, and what is
still apart then block by block (:func:`_large`), so that no link is lost.

Edge cases. Null text is empty; texts without a word are equal. Shorter texts than a shingle are one
shingle; very long ones are read whole. A null id links like any other but never names a component; a
component without an id has a null one. Repeated rows each get a row, and of them one stays. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.components import connected_components
from emberlane.llm.packing import chunks
from emberlane.llm.scratch import materialize, one_of_each, side_of, text_key
from emberlane.llm.simhash import RADIUS, near_links
from emberlane.llm.wordhash import trim

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 6
_RNG = np.random.default_rng(20)
_XOR, _ODD = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(k) for k in (0, 1))
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, joined, digest = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = [0, *(ends[: n - shingle]).tolist()]
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the ``BANDS * ROWS`` permutations."""
    low, out = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(out, ((low[k : k + 256, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return out


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys a set."""
    if not sets:
        return np.zeros((0, BANDS), np.int64)
    minima = np.array([_minima(s) for s in sets]).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    key = (minima * _MIX).sum(axis=2, dtype=np.uint64) ^ _SALT
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _fingerprint(hashes: np.ndarray) -> np.uint64:
    """The SimHash of a set: a bit is one if over half the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def _print(hashes: np.ndarray) -> int:
    """One signed number for a set: equal sets have the same."""
    n = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
    return n - (n >> 63 << 64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def _sets(column: pa.Array) -> Iterator[tuple[range, list[np.ndarray]]]:
    for p in chunks(column, 1_000_000):
        yield p, [shingle_set((x or "").encode()) for x in column[p.start : p.stop].to_pylist()]


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, fp, sim, keys`` of every row, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, sets in _sets(batch.column(1)):
                fp = pa.array([_print(s) for s in sets], pa.int64())
                sim = pa.array(np.array([_fingerprint(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[p.start : p.stop] for k in (0, 2)), fp, sim, _lists(_keys(sets))], names=["doc_id", "text_key", "fp", "sim", "keys"])
        trim()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), text_key(f"`{text_col}`").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long, sim long, keys array<long>")


def _joined(sets: list[np.ndarray], keys: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the first one (by position) of its component: all pairs with a common key or near fingerprints count."""
    n, part = len(sets), np.full(len(sets), -1)
    sims = np.array([_fingerprint(s) for s in sets], np.uint64)
    left = np.arange(n)  # those not yet reached
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(keys.ravel(), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    cut = np.searchsorted(flat[order], np.arange(flat.max() + 2))
    members: list[np.ndarray] = [order[a:b] // keys.shape[1] for a, b in zip(cut[:-1], cut[1:])]
    flat = flat.reshape(n, -1)
    for first in range(n):
        if part[first] >= 0:
            continue
        part[first], queue = first, [first]
        while queue:
            i = queue.pop()
            near = []
            for k in flat[i]:
                members[k] = members[k][part[members[k]] < 0]  # those reached leave every list
                near.append(members[k])
            left = left[part[left] < 0]
            near.append(left[np.bitwise_count(sims[left] ^ sims[i]) <= RADIUS])
            near = np.unique(np.concatenate(near))
            near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-6]
            for j in near:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                union = size[i] + size[j] - both
                if not union or both / union >= similarity:
                    part[j] = first
                    queue.append(j)
    return part


def _hashed(members: DataFrame) -> DataFrame:
    """``cluster, node, hashes`` from ``cluster, node, text``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, found in _sets(batch.column(2)):
                hashes = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[p.start : p.stop] for k in (0, 1)), hashes], names=["cluster", "node", "hashes"])

    return members.select("cluster", "node", "text").mapInArrow(sets, "cluster long, node long, hashes array<long>")


def _views(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _verified(hashed: DataFrame, similarity: float) -> DataFrame:
    """``fp, component`` of the sets in ``hashed`` (``cluster, node, hashes``), compared within each cluster, which one task holds."""

    def join(held: dict[int, np.ndarray]) -> tuple[list[int], list[int]]:
        nodes = sorted(held)
        found = [held[k] for k in nodes]
        part = _joined(found, _keys(found), similarity)
        return nodes, [nodes[k] for k in part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, ([], [])
        for batch in batches:
            for cluster, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _views(batch.column(2))):
                if cluster != now:
                    if held:
                        for a, b in zip(out, join(held)):
                            a += b
                    now, held = cluster, {}
                held[node] = hashes.copy()  # repeated rows come once
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["fp", "component"])
            out = ([], [])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in join(held)], names=["fp", "component"])
        held = {}
        trim()

    return hashed.select("cluster", "node", "hashes").repartition(F.col("cluster")).sortWithinPartitions("cluster").mapInArrow(run, "fp long, component long")


def _to_centres(hashed: DataFrame, stars: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links ``a, b`` of large clusters: each set is compared with the one that leads most of its keys.

    What leads very many sets goes to as many tasks as they need.
    """
    lead = stars.where("fp <> b").groupBy("fp", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    pairs = materialize(lead.join(hashed.select("node"), F.col("fp") == F.col("node"), "left_semi"), "leads")
    copies = materialize(pairs.groupBy(F.col("b").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("copies")), "copies")
    group = lambda centre, salt: F.xxhash64(centre, salt)
    led = pairs.join(copies, F.col("b") == F.col("_b")).select("fp", F.col("b").alias("led_by"), group("b", F.pmod(F.xxhash64("fp"), F.col("copies")).cast("int")).alias("grp"))
    mine = hashed.select("node", "hashes").join(led, F.col("node") == F.col("fp")).select("grp", F.col("led_by").alias("centre"), "node", "hashes")
    centres = hashed.join(copies, F.col("node") == F.col("_b")).select(F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "node", "hashes")
    centres = centres.select(group("node", "salt").alias("grp"), F.col("node").alias("centre"), F.lit(None).cast("long").alias("node"), "hashes")
    met = mine.unionByName(centres).repartition(F.col("grp")).sortWithinPartitions("grp", "centre", F.col("node").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = np.zeros(0, np.uint64)  # each centre comes before those it leads
        for batch in batches:
            ok = []
            for node, x in zip(batch.column(2).to_pylist(), _views(batch.column(3))):
                if node is None:
                    theirs = x.copy()
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, theirs, assume_unique=True))
                union = len(x) + len(theirs) - both
                ok.append(not union or both / union >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.select("grp", "centre", "node", "hashes").mapInArrow(compare, "a long, b long")


def _large(hashed: DataFrame, stars: DataFrame, similarity: float, most: int) -> DataFrame:
    """The same for clusters of more than ``most`` sets, in pieces of about that many.

    What is linked to centres is joined first. If several parts are left in a cluster, they are cut into blocks, and blocks are compared
    pair by pair, but for those of one and the same part: any two sets that are not yet joined meet in one task.
    """
    near = materialize(_to_centres(hashed, stars, similarity, most), "near")
    parts = connected_components(near)
    ids = hashed.select("cluster", "node").join(parts.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left")
    ids = materialize(ids.select("cluster", "node", F.coalesce("component", "node").alias("part")), "parts")
    sizes = ids.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") <= most
    rest = sizes.groupBy(F.col("cluster").alias("_c")).agg(F.count(F.lit(1)).alias("many"), F.ceil(F.sum(F.when(small, F.col("n"))) / most).alias("shared")).where("many > 1")
    sizes = materialize(sizes.join(rest, F.col("cluster") == F.col("_c")).select("cluster", F.col("part").alias("_p"), F.when(~small, F.col("part")).alias("pure"), F.when(small, F.col("shared")).otherwise(F.ceil(F.col("n") / most)).cast("long").alias("blocks")), "sizes")
    if sizes.isEmpty():
        return ids.select(F.col("node").alias("fp"), F.col("part").alias("component"))
    number = F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("part")).otherwise(F.col("node"))), F.col("blocks"))
    placed = ids.drop("cluster").join(sizes, F.col("part") == F.col("_p")).select("cluster", "node", "pure", F.xxhash64("cluster", F.coalesce("pure", F.lit(-1)), F.col("pure").isNull(), number).alias("block"))
    placed = materialize(placed, "placed")
    blocks = placed.select("cluster", "block", "pure").distinct()
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = ~F.coalesce(F.col("a.pure") == F.col("b.pure"), F.lit(False))
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")) & apart).select(F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    pairs = pairs.withColumn("pair", F.xxhash64("x", "y")).select("pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("of"))
    tasks = placed.select("node", "block").join(pairs, F.col("block") == F.col("of")).select(F.col("pair").alias("cluster"), F.col("node").alias("_n"))
    joined = _verified(hashed.select("node", "hashes").join(tasks, F.col("node") == F.col("_n")), similarity)
    links = near.unionAll(joined.select(F.col("fp").alias("a"), F.col("component").alias("b")))
    found = connected_components(links).select(F.col("node").alias("_n"), "component")
    return ids.select("node").join(found, F.col("node") == F.col("_n"), "left").select(F.col("node").alias("fp"), F.coalesce("component", "node").alias("component"))


def _sim_links(nodes: DataFrame) -> DataFrame:
    """Links ``fp, b`` that join all nodes (``fp, sim``) whose fingerprints are within three bits, to the least of a fingerprint."""
    least = materialize(nodes.groupBy("sim").agg(F.min("fp").alias("b"), F.max("fp").alias("a")), "sims")
    equal = nodes.select("fp", "sim").join(least.where("a <> b").select("sim", "b"), "sim").where("fp <> b").select("fp", "b")
    near = near_links(least.select(F.col("sim").alias("fp")))
    ends = near.join(least.select(F.col("sim").alias("a"), F.col("b").alias("fp")), "a").join(least.select(F.col("sim").alias("_b"), F.col("b").alias("to")), F.col("b") == F.col("_b"))
    return equal.unionAll(ends.select(F.greatest("fp", "to").alias("fp"), F.least("fp", "to").alias("b")))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The written sets' numbers of all rows, and of each distinct one the least of its component (``_fp, grp``)."""
    prints = materialize(_prints(docs, id_col, text_col), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nothing"), "doc_id", "text_key")).alias("first")
    nodes = materialize(prints.groupBy("fp").agg(first, F.any_value("sim").alias("sim"), F.any_value("keys").alias("keys")), "nodes")
    keyed = nodes.select("fp", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a <> b")
    stars = materialize(keyed.join(low.select("key", "b"), "key").select("fp", "b").unionAll(_sim_links(nodes)), "stars")
    found = connected_components(stars.select(F.col("fp").alias("a"), "b"))
    # a component's smallest node has no row of its own
    clusters = found.select("node", F.col("component").alias("cluster")).union(found.select("component", "component")).distinct()
    clusters = materialize(nodes.join(clusters, F.col("fp") == F.col("node")).select("first", "fp", "cluster"), "clusters")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), text_key(f"`{text_col}`").alias("text_key"))
    wanted = clusters.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), "fp", "cluster")
    members = texts.join(side_of(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(F.col("fp").alias("node"), "text", "cluster")
    hashed = _hashed(members)
    large = materialize(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("cluster").alias("_large")), "large")
    if large.isEmpty():
        joined = _verified(hashed, similarity)
    else:
        hashed = materialize(hashed.dropDuplicates(["node"]), "hashed")
        is_large = F.col("cluster") == F.col("_large")
        joined = _verified(hashed.join(side_of(large), is_large, "left_anti"), similarity)
        joined = joined.unionAll(_large(hashed.join(side_of(large), is_large, "left_semi"), stars, similarity, most))
    joined = joined.groupBy("fp").agg(F.min("component").alias("component"))
    return prints.select("doc_id", "text_key", "fp"), nodes.join(joined, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("grp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, most: int = 1024) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id of those reachable over links."""
    prints, classes = _classes(docs, id_col, text_col, similarity, most)
    rows = materialize(prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "grp"), "classes")
    ids = rows.groupBy(F.col("grp").alias("_grp")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, F.col("grp") == F.col("_grp")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, most: int = 1024) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, also of repeated rows and of rows without an id."""
    prints, classes = _classes(docs, id_col, text_col, similarity, most)
    rows = prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "grp")
    return one_of_each(docs, rows, id_col, text_col)
