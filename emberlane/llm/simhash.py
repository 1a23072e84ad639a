"""SimHash near-dedup with pigeonring filtering.

Method. The fingerprint's 64 bits are a ring of four 16-bit segments. Two fingerprints within three bits
have a segment ``i`` from which every chain of consecutive segments keeps its proportional budget: after
1, 2, 3, 4 segments at most 0, 1, 2, 3 bits differ. The first two budgets are the join key: segment ``i``
as it is, segment ``i + 1`` with one bit masked out, for each of its 16 bits. Within a key the budget of
three segments is checked before the full Hamming distance. Distinct fingerprints are paired, never
documents, so a group of copies of any size is one entry; within a key only links that join two parts
are passed on (a spanning forest), never all pairs. Keys are counted first, and one with too many
fingerprints is split under finer keys by the same principle (:func:`_spread`). Components of the links are
found by alternating stars (:mod:`emberlane.llm.components`).

Edge cases. Null text is empty; a text without a word has fingerprint zero and is linked like any other.
Shorter texts than a shingle are one shingle; very long ones are read whole, in parts. A null id links like
any other but never names a component; a component without an id has a null one. Repeated rows each get a
row. An empty table gives no rows. Other columns are not read.
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

SEGMENTS, WIDTH, RADIUS = 4, 16, 3
_ONES16 = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text, for reference."""
    return int(_fingerprints([text.encode()], shingle)[0])


def _fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if over half the shingles' hashes have it."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    owner: list[int] = []  # of each run of hashes its text
    counts: list[int] = []
    ones = np.zeros((len(texts), 64), dtype=np.int64)

    def count() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.concatenate([[0], np.cumsum(counts)])
            for k, s, e in zip(owner, at[:-1], at[1:]):
                ones[k] += bits[s:e].sum(axis=0, dtype=np.int64)
        for x in (hashes, owner, counts):
            x.clear()

    total = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        for words in _word_runs(text.lower(), shingle):
            n = len(words)
            if n > shingle:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
                starts = [0, *(ends[: n - shingle]).tolist()]
                hashes += [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
            else:
                hashes.append(digest(b" ".join(words), 42))
            counts.append(max(1, n - shingle + 1))
            owner.append(k)
            total[k] += counts[-1]
            if len(hashes) > _HASHES:
                count()
    count()
    out[:] = np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    return out


_HASHES, _PART = 1 << 18, 1 << 20


def _word_runs(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that share ``shingle - 1`` words, so that each shingle is in one run."""
    if len(text) <= _PART:
        if words := text.split():
            yield words
        return
    at, held, none_yet = 0, [], True
    while at < len(text):
        end = min(at + _PART, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        held += text[at:end].split()
        at = end
        if len(held) >= shingle:
            yield held
            held, none_yet = held[len(held) - shingle + 1 :], False
    if held and none_yet:
        yield held


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, text_key, fp`` (signed 64-bit) of every row, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_fingerprints([(x or "").encode() for x in batch.column(1)[p.start : p.stop].to_pylist()], shingle) for p in chunks(batch.column(1), 1_000_000)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), text_key(f"`{text_col}`").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _distance(a: np.ndarray, b: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Whether the chain of three segments from ``seg`` keeps its budget, and then the whole ring."""
    x = a ^ b
    far = ((seg + np.uint64(3)) % np.uint64(4)) * np.uint64(16)  # the segment that the chain of three leaves out
    three = x & ~(np.uint64(0xFFFF) << far)
    ok = _popcount(three) <= 2
    ok[ok] = _popcount(x[ok]) <= RADIUS
    return ok


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fp: np.ndarray, seg: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one key's fingerprints: only parts not yet reached are compared."""
    out, waiting, segs = [], np.arange(len(fp)), np.uint64(seg)
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            near = _distance(fp[waiting], fp[i], np.full(len(waiting), segs))
            if near.any():
                hit, waiting = waiting[near], waiting[~near]
                out += [(int(i), int(j)) for j in hit]
                queue += list(hit)
    return out


def _keyed(prints: DataFrame) -> DataFrame:
    """``fp, key, rest`` of every fingerprint and first chain; ``rest`` holds the 32 bits that the key leaves open."""
    seg = lambda i: F.shiftrightunsigned("fp", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    entries = [
        F.struct(
            F.shiftleft(F.lit(i).cast("long"), 52).bitwiseOR(F.shiftleft(F.lit(b).cast("long"), 48)).bitwiseOR(F.shiftleft(seg(i), 16)).bitwiseOR(seg(i + 1).bitwiseAND(F.lit(0xFFFF & ~(1 << b)))).alias("key"),
            F.shiftleft(seg(i + 2), 16).bitwiseOR(seg(i + 3)).alias("rest"),
        )
        for i in range(SEGMENTS)
        for b in range(WIDTH)
    ]
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.key", "e.rest")


def _refined(keyed: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The rows under finer keys: of as many parts as bits may differ, and one more, some part is equal."""
    entries, at = [], 0
    for j, size in enumerate(sizes):
        part = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << size) - 1))
        rest = F.col("rest").bitwiseAND(F.lit((1 << at) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", at + size), at))
        finer = F.col("key").bitwiseAND(F.lit(3 << 52)).bitwiseOR(F.xxhash64("key", F.lit(j), part).bitwiseAND(F.lit((1 << 52) - 1)))
        entries.append(F.struct(finer.alias("key"), rest.alias("rest")))
        at += size
    return keyed.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.key", "e.rest")


#: How the open bits of a hot key are cut, level by level; after the last at most 15 bits are open.
REFINEMENTS = ((8, 8, 8, 8), (6, 6, 6, 6), (5, 5, 4, 4))


def _spread(keyed: DataFrame, n: int, most: int) -> list[DataFrame]:
    """The rows in tables none of which has a key with more than ``4 * most`` fingerprints, or else all bits but 15 fixed.

    Keys are counted by a hash of theirs, before any row is shuffled; what shares a full cell goes under finer keys. That
    splits the work on a key without losing a pair: two fingerprints within the radius meet under one of the finer keys.
    """
    out = []
    for sizes in REFINEMENTS:
        cells = 1 << max(0, (n // most).bit_length())
        cell = F.xxhash64("key").bitwiseAND(F.lit(cells - 1))
        full = keyed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * most)
        full = materialize(full.select("cell", "n"), "cells")
        n = 4 * (full.agg(F.sum("n")).first()[0] or 0)
        if not n:
            return [*out, keyed]
        side = side_of(full.select("cell"))
        out.append(keyed.join(side, cell == F.col("cell"), "left_anti"))
        keyed = _refined(keyed.join(side, cell == F.col("cell"), "left_semi"), sizes)
    return [*out, keyed]


def near_links(prints: DataFrame, *, most: int = 4096) -> DataFrame:
    """Links ``a, b`` that join all fingerprints (``fp``, distinct) within three bits."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
            if len(now[0]):
                # all but the last key are complete; the last may go on in the next batch
                cut = int(np.searchsorted(now[0], now[0][-1]))
                if cut:
                    yield _pairs([*held, tuple(x[:cut] for x in now)])
                    held = []
                held.append(tuple(x[cut:] for x in now))
        if held:
            yield _pairs(held)

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.repartition(n, "fp")  # a small table, of which each row becomes many
    found = None
    for part in _spread(_keyed(prints), prints.count() * SEGMENTS * WIDTH, most):
        sorted_ = part.select("fp", "key").repartition(F.col("key")).sortWithinPartitions("key")
        more = sorted_.mapInArrow(links, "a long, b long")
        found = more if found is None else found.unionAll(more)
    return found.distinct()


def _pairs(parts: list[tuple]) -> pa.RecordBatch:
    key, fp = (np.concatenate([p[i] for p in parts]) for i in range(2))
    bits = fp.view(np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    a, b = [], []
    small = np.repeat(size <= 8, size)
    for lag in range(1, 8):  # small groups: all at once, by distance in the sorted order
        at = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        if not len(at):
            break
        ok = at[_distance(bits[at], bits[at + lag], (key[at] >> 52).astype(np.uint64))]
        a.append(fp[ok])
        b.append(fp[ok + lag])
    for s, n in zip(cut[size > 8], size[size > 8]):
        found = _forest(bits[s : s + n], int(key[s] >> 52))
        if found:
            x, y = np.array(found).T
            a.append(fp[s + x])
            b.append(fp[s + y])
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The written fingerprints of all rows, and of each distinct one the smallest of its component (``_fp, grp``)."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    found = connected_components(near_links(nodes))
    return prints, nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("grp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id of those reachable over links."""
    prints, classes = _classes(docs, id_col, text_col, shingle)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("id")).join(classes, F.col("fp") == F.col("_fp"))
    ids = materialize(least.groupBy("grp").agg(F.min("id").alias("component_id")), "ids")  # nulls are no ids, but link
    class_of = classes.join(ids, "grp").select("_fp", "component_id")
    return prints.join(class_of, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, also of repeated rows and of rows without an id."""
    prints, classes = _classes(docs, id_col, text_col, shingle)
    rows = prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "grp")
    return one_of_each(docs, rows, id_col, text_col)
