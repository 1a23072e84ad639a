"""Similar sets: all pairs of word sets whose Jaccard similarity reaches a threshold, by parts of the sets.

Method. Two sets of ``na`` and ``nb`` words are as similar as ``t`` only if at most ``(1 - t) / (1 + t) * (na + nb)`` words are in one of
them alone. The words are dealt over more parts than that by their hashes, so at least one part has the same words in both, and so it has
among any of the parts that are one more than those words. Sets are keyed by their parts: sizes fall into classes by factors of ``1 / t``,
each with its number of parts; a set is found under all parts of its own class and looks for no larger ones, in each class that they may
be in, by its fullest parts. The pairs that meet are a superset of the similar ones, and each is then compared by its whole sets.

Sets are moved little: a part is a number of 64 bits, and before whole sets meet, parities of their words in 512 bits or more (which
differ in no more bits than words differ) leave out most that are not similar. Sets that follow one leader form a cluster, which is compared at
once in a task, in blocks if it is large; only pairs between clusters have rows of their own. No pair is left out by the clusters.

Ids that are null are in no pair; sets without words have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberlane.sources.tables import written

#: Sets of a cluster that one task compares with as many others; rows that are broadcast at most; words of the sets that are keyed at once.
MOST, BROADCAST, AT_ONCE = 512, 1_000_000, 1 << 21
LEAST = 8  # numbers of 64 bits
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLACK = 1e-6


def small_side(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A written table as a join's side: broadcast only if its rows have been counted and are few."""
    return F.broadcast(table) if table.count() <= most else table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _apart(na, nb, t: float):
    """The words that two similar sets may have in one of them alone, at most."""
    return np.floor((1 - t) / (1 + t) * (na + nb) + _SLACK).astype(np.int64)


def _edges(largest: int, t: float) -> np.ndarray:
    """The least sizes of the classes, up to one beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] / t)))
    return np.array(edges)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of lists, and where each list begins and ends."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), ends


def _pieces(ends: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of lists with about ``most`` words."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def part_keys(words: np.ndarray, ends: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, sig, role`` of the sets' parts: the set's place, the part's number, and 1 (is found by it), 2 (looks by it) or 3."""
    n = np.diff(ends)
    if not n.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    edges = _edges(int(n.max()), t)
    mixed, high = _mix(words), (words >> np.uint64(32)).astype(np.int64)
    out = []
    for k, (low, up) in enumerate(zip(edges[:-1], edges[1:] - 1)):
        sets = np.flatnonzero((n >= low) & (t * n <= up + _SLACK))
        if not len(sets):
            continue
        parts = int(_apart(int(up / t + _SLACK), up, t)) + 1
        size = n[sets]
        place = np.repeat(np.arange(len(sets)), size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[sets], size)
        cell = place * parts + high[at] % parts
        sums, full = np.zeros(len(sets) * parts, np.uint64), np.bincount(cell, minlength=len(sets) * parts).reshape(-1, parts)
        np.add.at(sums, cell, mixed[at])
        salt = _mix(np.arange(parts, dtype=np.uint64) + np.uint64(k << 32 | 1))
        sig = _mix(sums.reshape(-1, parts) + salt)
        looks = np.empty((len(sets), parts), np.int8)  # the fullest, one more than words may be apart
        np.put_along_axis(looks, np.argsort(-full, axis=1, kind="stable"), (np.arange(parts) <= _apart(size, np.minimum(size, up), t)[:, None]).astype(np.int8) * 2, 1)
        role = looks + (size <= up)[:, None].astype(np.int8)
        row, col = np.nonzero(role)
        out.append((sets[row], sig[row, col], role[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out))


def parities(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set whether an odd number of its words falls on each of 512 bits, or of twice, four times, ... as many if it has more words.

    Numbers of 64 bits, and where each set's begin and end. Half of the bits on the other half are those of half the number.
    """
    n = np.diff(ends)
    longs = LEAST << np.ceil(np.log2(np.maximum(n, 64 * LEAST) / (64 * LEAST))).astype(np.int64)
    cuts = np.append(0, np.cumsum(longs))
    place = np.repeat(cuts[:-1] * 64, n) + (words[ends[0] : ends[-1]] & np.repeat(longs * 64 - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=cuts[-1] * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64), cuts


def _sketched(sets: DataFrame) -> DataFrame:
    """``id, n, s``: sizes and parities."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = _flat(batch.column(1))
            for a, b in _pieces(ends):
                s, cuts = parities(words, ends[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends[a : b + 1]).astype(np.int32)), pa.ListArray.from_arrays(cuts.astype(np.int32), s)], names=["id", "n", "s"])

    return sets.select("id", "w").mapInArrow(run, f"id {kind}, n int, s array<long>")


def _keyed(sets: DataFrame, t: float) -> DataFrame:
    """``sig, id, role`` of every set's parts."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = _flat(batch.column(1))
            for a, b in _pieces(ends):
                at, sig, role = part_keys(words, ends[a : b + 1], t)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), batch.column(0).take(pa.array(at + a)), pa.array(role)], names=["sig", "id", "role"])

    return sets.select("id", "w").mapInArrow(run, f"sig long, id {kind}, role tinyint")


def _may_be(pairs: DataFrame, sketches: DataFrame, t: float) -> DataFrame:
    """The pairs ``first, id`` that sizes and parities do not rule out."""
    side = lambda name, as_: sketches.select(F.col("id").alias(as_), F.struct("n", "s").alias(name))
    both = pairs.join(side("_a", "first"), "first").join(side("_b", "id"), "id")
    least = F.least(F.size("_a.s"), F.size("_b.s"))
    halved = lambda s: F.when(F.size(s) > least, F.zip_with(F.slice(s, 1, least), F.slice(s, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))
    # of very different sizes (a low threshold) the parities still differ in number: null, which rules nothing out
    bits = F.aggregate(F.zip_with(halved("_a.s"), halved("_b.s"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.least("_a.n", "_b.n") >= t * F.greatest("_a.n", "_b.n") - _SLACK
    return both.where(sizes & (F.coalesce(bits, F.lit(0)) <= (1 - t) / (1 + t) * (F.col("_a.n") + F.col("_b.n")) + _SLACK)).select("first", "id")


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many words each of the first ``split`` sets has in common with each set."""
    flat, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    new = np.append(True, flat[1:] != flat[:-1])
    word = np.cumsum(new) - 1
    several = np.bincount(word)[word] > 1
    _, word = np.unique(word[several], return_inverse=True)
    place, out = place[several], np.zeros((split, len(sets)), np.float32)
    cuts = np.searchsorted(word, np.arange(0, word[-1] + 2049, 2048)) if len(word) else []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        has = np.zeros((len(sets), 2048), np.float32)
        has[place[a:b], word[a:b] - 2048 * k] = 1
        out += has[:split] @ has.T  # counts below 2 ** 24 are exact
    return out


def similar_pairs(sets: list[np.ndarray], sides: list[int], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``a, b`` of similar sets with their similarities, each pair once; where sides 0 and 1 differ, only pairs of the two."""
    order = np.argsort(sides, kind="stable")
    sets, split = [sets[k] for k in order], len(sides) - sum(sides)
    size = np.array([len(s) for s in sets])
    if len(sets) < 2 or not split:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(sets) <= 4:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) if k < j else 0 for j, y in enumerate(sets)] for k, x in enumerate(sets[:split])])
    else:
        shared = _shared(sets, split).astype(np.int64)
    union = size[:split, None] + size - shared
    near = shared >= t * union
    near[:, :split] &= np.triu(np.ones((split, split), bool), 1) & (split == len(sets))
    a, b = np.nonzero(near)
    return order[a], order[b], shared[a, b] / union[a, b]


def _met(rows: DataFrame, t: float) -> DataFrame:
    """``first, id, similarity`` of similar sets with a common ``task`` (``task, side, id, w``), one task's at a time."""
    kind, arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, ([], [], []), ([], [], [])

        def compare() -> None:
            ids, sides, sets = held
            for a, b, s in zip(*(x.tolist() for x in similar_pairs(sets, sides, t))):
                if ids[a] != ids[b]:
                    for x, y in zip(out, (min(ids[a], ids[b]), max(ids[a], ids[b]), s)):
                        x.append(y)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], arrow), pa.array(out[1], arrow), pa.array(out[2], pa.float64())], names=["first", "id", "similarity"])

        for batch in batches:
            words, ends = _flat(batch.column(3))
            for k, (task, side, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if task != now:
                    compare()
                    now, held = task, ([], [], [])
                for x, y in zip(held, (id_, side, words[ends[k] : ends[k + 1]].copy())):
                    x.append(y)
            yield made()
            out = ([], [], [])
        compare()
        yield made()

    return rows.select("task", "side", "id", "w").repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, f"first {kind}, id {kind}, similarity double")


def _within(sets: DataFrame, members: DataFrame, t: float, folder: str | None, most: int) -> DataFrame:
    """The similar pairs of each cluster (``id, cluster``); a large one is cut into blocks that meet two by two."""
    sizes = written(members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks")), "sizes", folder)
    placed = members.join(small_side(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k meets itself, those after it as side 0 and those before it as side 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("_o", other).select("id", F.struct("cluster", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y")).alias("task"), (F.col("block") > F.col("_o")).cast("int").alias("side"))
    tasks = written(met.select("id", F.xxhash64("task").alias("task"), "side"), "tasks", folder)
    return _met(sets.select("id", "w").join(small_side(tasks), "id"), t)


def _between(pairs: DataFrame, sets: DataFrame, t: float, folder: str | None) -> DataFrame:
    """The similar ones of pairs ``first, id``."""
    ids = written(pairs.select(F.explode(F.array("first", "id")).alias("id")).distinct(), "wanted", folder)
    wanted = written(sets.join(small_side(ids), "id", "left_semi").select("id", "w"), "members", folder)
    full = pairs.join(wanted.select(F.col("id").alias("first"), F.col("w").alias("wa")), "first").join(wanted.withColumnRenamed("w", "wb"), "id")
    shared = F.size(F.array_intersect("wa", "wb"))
    union: Column = F.size("wa") + F.size("wb") - shared
    return full.where(shared >= t * union).select("first", "id", (shared / union).alias("similarity"))


def similar(sets: DataFrame, t: float, folder: str | None = None, most: int = MOST) -> DataFrame:
    """All pairs ``first < id`` of sets (``id``, ``w``: distinct longs, well mixed) with similarity ``t`` or more, written to ``folder``."""
    sets = sets.where(F.col("id").isNotNull() & (F.size("w") > 0))
    sketches = written(_sketched(sets), "sketches", folder)
    here = Window.partitionBy("sig")
    keyed = _keyed(sets, t).withColumns({"_n": F.count(F.lit(1)).over(here), "leader": F.min("id").over(here), "_roles": F.bit_or("role").over(here)})
    keyed = written(keyed.where("_n > 1 and _roles = 3").drop("_n", "_roles"), "keys", folder)
    led = _may_be(keyed.where("id > leader").select(F.col("leader").alias("first"), "id").distinct(), sketches, t)
    own = written(led.groupBy("id").agg(F.min("first").alias("cluster")), "leaders", folder)
    ahead = own.join(own.select(F.col("id").alias("cluster"), F.col("cluster").alias("_c")), "cluster", "left").select("id", F.coalesce("_c", "cluster").alias("cluster"))
    both = ahead.unionByName(ahead.select(F.col("cluster").alias("id"), "cluster"))
    clusters = written(both.groupBy("id").agg(F.min("cluster").alias("cluster")), "clusters", folder)
    keyed = keyed.drop("leader").join(small_side(clusters), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    several = keyed.withColumns({"_a": F.min("cluster").over(here), "_b": F.max("cluster").over(here)}).where("_a < _b").drop("_a", "_b")
    several = written(several, "several", folder)
    a, b = several.where("role > 1").alias("a"), several.where("role % 2 = 1").alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cluster") != F.col("b.cluster")) & (F.col("a.id") != F.col("b.id")))
    met = met.select(F.least("a.id", "b.id").alias("first"), F.greatest("a.id", "b.id").alias("id")).distinct()
    apart = written(_may_be(met, sketches, t), "apart", folder)
    found = _within(sets, clusters, t, folder, most).unionByName(_between(apart, sets, t, folder))
    return written(found.groupBy("first", "id").agg(F.max("similarity").alias("similarity")), "similar", folder)

