"""Exact repeats across documents from sampled seeds: the part that byte and word dedup share.

A text is a sequence of symbols (bytes, or words). The question is, for every window of ``width`` symbols,
whether the same window starts in a document with a smaller id.

1. Documents are put into blocks of about ``block_bytes`` and written once, bucketed by block, so that no
   later step moves text.
2. Of each window the ``seed`` symbols with the smallest hash are its anchor (winnowing). Equal windows
   have equal anchors at equal distance, so only windows with equal anchors are ever compared. A seed
   covers a run of windows; that run is an item.
3. Blocks exchange the anchors' hashes alone, as compressed sorted runs with the number of different items
   behind each, and learn which of them occur elsewhere too, and which of those are hot (more than
   ``hot_items`` different items in all blocks).
4. Of those, blocks exchange the items' symbols (equal items of a block once, with the smallest id; that
   is what keeps hot passages small). The receiver of an anchor extends its items both ways, symbol by
   symbol, into classes of equal windows, and answers which windows have an equal in a smaller document.
   Items of a hot anchor go window by window instead, by 128 bits of hash, to receivers chosen by the
   window: a block sends each different window once, so a passage in every document is a row a block.
5. Each block marks the symbols that such windows cover.

Nothing is sampled away: winnowing assigns every window to an anchor. The range of hashes that a receiver
gets holds about ``target_bytes`` of text, however many receivers that makes, and no anchor has more than
``hot_items`` items there; no group of equal passages is ever expanded into pairs. Items of a block are
compared by 64 bits of hash, windows of an anchor by their bytes to the right and 64 bits to the left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm import wordhash
from emberlane.llm.packing import chunks
from emberlane.llm.scratch import materialize, shared_dir

_CHUNK = 1 << 15
_BITS = np.uint64(15 + 1)
HASH_BITS = 48


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as compressed byte planes of their differences."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), dtype=np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


@dataclass
class Text:
    """A block: document ids, the bytes of all texts, and where each starts."""

    ids: np.ndarray
    data: np.ndarray
    at: np.ndarray


def to_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """A written table of blocks, bucketed by block; a null id counts as larger than all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            data, at = wordhash.buffers(pa.concat_arrays([t.cast(pa.large_string()) for t in texts]))
            who = pa.concat_arrays(ids)
            raw = squeeze(data.tobytes())
            cols = [pa.array([number]), pa.array([len(data)]), pa.array([np.asarray(who.fill_null(np.iinfo(np.int64).max)).astype("<i8").tobytes()], pa.binary()), pa.array([np.asarray(who.is_null()).tobytes()], pa.binary()), pa.array([np.diff(at).astype("<i8").tobytes()], pa.binary()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "raw", "ids", "nulls", "sizes", "data"])

        for batch in batches:
            for part in chunks(batch.column(1), block_bytes):
                ids.append(batch.column(0)[part.start : part.stop])
                texts.append(batch.column(1)[part.start : part.stop])
                size += texts[-1].nbytes
                if size >= block_bytes:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield made()

    spark = docs.sparkSession
    made = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "block long, raw long, ids binary, nulls binary, sizes binary, data binary")
    name = f"emberlane_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    made.write.bucketBy(_partitions(spark), "block").option("path", path).option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the catalog's entry has done its service, the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_block(ids: bytes, sizes: bytes, data: bytes) -> Text:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype="<i8"))])
    return Text(np.frombuffer(ids, dtype="<i8"), np.frombuffer(expand(data), dtype=np.uint8), at)


@dataclass
class Items:
    """Runs of windows by anchor: windows ``low .. high`` (inclusive) have their anchor at ``anchor``."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hash: np.ndarray
    content: np.ndarray
    doc: np.ndarray

    def take(self, which: np.ndarray) -> "Items":
        return Items(*(x[which] for x in (self.anchor, self.low, self.high, self.hash, self.content, self.doc)))


def find_items(symbols: np.ndarray, at: np.ndarray, width: int, seed: int) -> Items:
    """All items of a block; ``symbols`` are 64-bit hashes (or bytes), ``at`` the first symbol of each document."""
    parts: list[tuple] = []
    total = len(symbols)
    span = width - seed + 1  # seeds in a window
    pow_, inv = wordhash._POW, wordhash._INV
    for base in range(0, max(0, total - width + 1), _CHUNK):
        n = min(_CHUNK, total - width + 1 - base)  # windows that start here
        m = n + width - 1
        near = np.arange(np.searchsorted(at, base, side="right") - 1, np.searchsorted(at, base + n))
        end = np.repeat(at[near + 1], np.minimum(at[near + 1], base + n) - np.maximum(at[near], base))
        ok = end - np.arange(base, base + n) >= width
        if not ok.any():
            continue
        sums = np.zeros(m + 1, dtype=np.uint64)
        part = symbols[base : base + m]
        np.cumsum((wordhash._BYTE[part] if part.dtype == np.uint8 else part) * pow_[:m], out=sums[1:])
        seeds = wordhash.mix((sums[seed:] - sums[:-seed]) * inv[: m - seed + 1])
        key = (seeds >> _BITS << _BITS) | np.arange(m - seed + 1, dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        where = (key[:n] & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
        change = np.ones(n, dtype=bool)
        change[1:] = (where[1:] != where[:-1]) | ~ok[:-1]
        low = np.flatnonzero(change & ok)
        stop = np.ones(n, dtype=bool)
        stop[:-1] = (where[1:] != where[:-1]) | ~ok[1:]
        high = np.flatnonzero(stop & ok)
        a = where[low]
        whole = (sums[high + width] - sums[low]) * inv[low]
        # anchors have small hashes, so they are hashed anew: targets are ranges of an even spread
        parts.append((a + base, low + base, high + base, wordhash.mix(seeds[a] + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - HASH_BITS), wordhash.mix(whole + (a - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    if not parts:
        none = np.zeros(0, np.int64)
        return Items(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    a, low, high, h, content = (np.concatenate(x) for x in zip(*parts))
    return Items(a, low, high, h, content, np.searchsorted(at, low, side="right") - 1)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts ``key``, and where each group starts in it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _local(items: Items, ids: np.ndarray) -> np.ndarray:
    """Sorted hashes that occur in two documents of the block itself."""
    order, cut = _groups(items.hash)
    who = ids[items.doc[order]]
    if not len(cut):
        return np.zeros(0, np.uint64)
    many = np.minimum.reduceat(who, cut) != np.maximum.reduceat(who, cut)
    return items.hash[order[cut[many]]]


def _item_counts(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a block's anchors, sorted, and how many different items each has (65,535 at most)."""
    order = np.lexsort((items.content, items.hash))
    h, c = items.hash[order], items.content[order]
    if not len(h):
        return h, np.zeros(0, np.uint16)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    new = first.copy()
    new[1:] |= c[1:] != c[:-1]
    cut = np.flatnonzero(first)
    return h[cut], np.minimum(np.add.reduceat(new.astype(np.int64), cut), 65_535).astype(np.uint16)


@dataclass
class Shared:
    """What a block's surviving items are: all of them, and each distinct content once; and which of those are hot."""

    items: Items
    of: np.ndarray  # per item its distinct content
    first: np.ndarray  # per distinct content an item with the smallest document id
    smallest: np.ndarray  # per distinct content that id
    hot: np.ndarray  # whether a distinct content belongs to a hot anchor


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted list."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def survivors(items: Items, ids: np.ndarray, elsewhere: np.ndarray, hot: np.ndarray) -> Shared:
    known = np.union1d(_local(items, ids), elsewhere)
    items = items.take(_among(items.hash, known))
    order, cut = _groups(items.content)
    size = np.diff(np.append(cut, len(order)))
    group = np.repeat(np.arange(len(cut)), size)
    who = ids[items.doc[order]]
    smallest = np.minimum.reduceat(who, cut) if len(cut) else np.zeros(0, np.int64)
    lead = np.flatnonzero(who == smallest[group])
    first = np.zeros(len(cut), dtype=np.int64)
    first[group[lead][::-1]] = order[lead][::-1]
    of = np.zeros(len(order), dtype=np.int64)
    of[order] = group
    return Shared(items, of, first, smallest, _among(items.hash[first], hot))


@dataclass
class Windows:
    """The windows of a block's hot contents: which content, where it starts in the content's first item, and its class."""

    content: np.ndarray
    start: np.ndarray
    of: np.ndarray
    left: np.ndarray  # per class its hash, as two numbers, sorted
    right: np.ndarray
    smallest: np.ndarray  # per class the smallest document id


def hot_windows(s: Shared, symbols: np.ndarray, width: int) -> Windows:
    content = np.flatnonzero(s.hot)
    lead = s.first[content]
    low, n = s.items.low[lead], s.items.high[lead] - s.items.low[lead] + 1
    owner = np.repeat(np.arange(len(content)), n)
    start = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    raw = b"".join(xxhash.xxh128_digest(symbols[w : w + width].tobytes()) for w in start.tolist())
    both = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (both[order[1:]] != both[order[:-1]]).any(axis=1)
    of = np.zeros(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    cut = np.flatnonzero(new)
    who = s.smallest[content[owner]][order]
    smallest = np.minimum.reduceat(who, cut) if len(cut) else np.zeros(0, np.int64)
    return Windows(content[owner], start, of, both[order[cut], 0], both[order[cut], 1], smallest)


def _hot_starts(s: Shared, w: Windows, taken: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the windows of hot items start that have an equal in a smaller document, here or elsewhere."""
    begin = np.zeros(len(s.first) + 1, dtype=np.int64)
    np.cumsum(np.bincount(w.content, minlength=len(s.first)), out=begin[1:])  # windows lie by content, in order
    item = np.flatnonzero(s.hot[s.of])
    n = (s.items.high - s.items.low + 1)[item]
    owner = np.repeat(item, n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    kind = w.of[begin[s.of[owner]] + step]
    hit = taken[kind] | (ids[s.items.doc[owner]] > w.smallest[kind])
    return s.items.low[owner[hit]] + step[hit]


@dataclass
class Codec:
    """How symbols are read from a block and how items travel.

    ``symbols(text)`` gives symbol hashes (or bytes), the first symbol of each document, and what ``encode`` needs.
    ``encode(text, parts, items)`` turns items into bytes; ``answer(pieces)`` gets the decoded pieces of a
    target, a list of ``(bytes, ids)``, and returns for each piece and item a mask of the windows (bit
    ``anchor - window``) that have an equal in a smaller document.
    """

    width: int
    seed: int
    symbols: Callable
    encode: Callable
    answer: Callable


def target_runs(hashes: np.ndarray, targets: int, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The targets of sorted hashes (even ranges of their values), and where each one's run starts, with the end: the work is that of the hashes, however many targets there are."""
    number = ((hashes >> np.uint64(bits - 32)) * np.uint64(targets)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(number)), dtype=bool), number[1:] != number[:-1]]))
    return number[start].astype(np.int64), np.append(start, len(hashes))


def repeated_windows(docs: DataFrame, codec: Codec, finish: Callable, schema: str, *, id_col: str, text_col: str, block_bytes: int, target_bytes: int, hot_items: int) -> DataFrame:
    """``finish(text, parts, covered)`` of every block, where ``covered`` marks the symbols to remove."""
    spark = docs.sparkSession
    blocks = to_blocks(docs, id_col, text_col, block_bytes)
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    targets = max(1, raw // target_bytes)
    width, seed = codec.width, codec.seed

    def load(batch: pa.RecordBatch, k: int) -> tuple[Text, np.ndarray, np.ndarray, Items, object]:
        text = read_block(batch.column("ids")[k].as_py(), batch.column("sizes")[k].as_py(), batch.column("data")[k].as_py())
        symbols, at, parts = codec.symbols(text)
        return text, symbols, at, find_items(symbols, at, width, seed), parts

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                _, _, _, items, _ = load(batch, k)
                hashes, counts = _item_counts(items)
                full, cut = target_runs(hashes, targets)
                each = [(pack_sorted(hashes[s:e]), squeeze(counts[s:e].tobytes())) for s, e in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), batch.column("block")[k].as_py())), pa.array([x for x, _ in each], pa.binary()), pa.array([x for _, x in each], pa.binary())], names=["target", "block", "hashes", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        runs = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(expand(x), dtype=np.uint16) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order, cut = _groups(np.concatenate(runs))
        size = np.diff(np.append(cut, len(order)))
        twice, many = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(size > 1, size)
        many[order] = np.repeat((size > 1) & (np.add.reduceat(counts[order], cut) > hot_items), size)
        base = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        found = [(r[twice[s:e]], r[many[s:e]]) for r, s, e in zip(runs, base[:-1], base[1:])]
        keep = [i for i, (r, _) in enumerate(found) if len(r)]
        column = lambda j: pa.array([pack_sorted(found[i][j]) for i in keep], pa.binary())
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())).combine_chunks(), "hashes": column(0), "hot": column(1)})

    announced = blocks.select("block", "ids", "sizes", "data").mapInArrow(announce, "target int, block long, hashes binary, counts binary")
    met = announced.groupBy("target").applyInArrow(meet, "block long, hashes binary, hot binary")
    shared_hashes = materialize(met.groupBy("block").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("hot").alias("hot")), "shared")

    def surviving(batch: pa.RecordBatch, k: int) -> tuple[Text, np.ndarray, np.ndarray, object, Shared]:
        text, symbols, at, items, parts = load(batch, k)
        known, hot = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in batch.column(c)[k].as_py() or ())])) for c in ("hashes", "hot"))
        return text, symbols, at, parts, survivors(items, text.ids, known, hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, symbols, _, parts, s = surviving(batch, k)
                block = batch.column("block")[k].as_py()

                def piece(t: int, which: np.ndarray, docs: np.ndarray, body: bytes, block: int = block) -> pa.RecordBatch:
                    cols = [pa.array([t], pa.int32()), pa.array([block]), pa.array([squeeze(which.astype("<u4").tobytes())], pa.binary()), pa.array([squeeze(docs.astype("<i8").tobytes())], pa.binary()), pa.array([body], pa.binary())]
                    return pa.RecordBatch.from_arrays(cols, names=["target", "block", "which", "docs", "body"])

                cold = np.flatnonzero(~s.hot)
                order = cold[np.argsort(s.items.hash[s.first[cold]], kind="stable")]
                full, cut = target_runs(s.items.hash[s.first[order]], targets)
                for t, a, b in zip(full, cut[:-1], cut[1:]):
                    which, body = codec.encode(text, parts, s.items, s.first, order[a:b])
                    yield piece(t, which, s.smallest[which], body)
                if s.hot.any():
                    w = hot_windows(s, symbols, width)
                    full, cut = target_runs(w.left, targets, 64)
                    for t, a, b in zip(full, cut[:-1], cut[1:]):
                        which = np.arange(a, b)
                        yield piece(targets + t, which, w.smallest[which], np.concatenate([w.left[which], w.right[which]]).tobytes())

    def classes(bodies: list[bytes], docs: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block's windows those whose class has a smaller document elsewhere (1, else 0)."""
        both = [np.frombuffer(x, dtype="<u8").reshape(2, -1) for x in bodies]
        left, right, who = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]), np.concatenate(docs)
        order = np.lexsort((right, left))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (left[order[1:]] != left[order[:-1]]) | (right[order[1:]] != right[order[:-1]])
        cut = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(who[order], cut), np.diff(np.append(cut, len(order))))
        out = np.zeros(len(order), dtype=np.uint64)
        out[order[who[order] > least]] = 1
        base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        return [out[s:e] for s, e in zip(base[:-1], base[1:])]

    def resolve(table: pa.Table) -> pa.Table:
        docs = [np.frombuffer(expand(x), dtype="<i8") for x in table.column("docs").to_pylist()]
        hot = table.column("target")[0].as_py() >= targets
        bodies = table.column("body").to_pylist()
        masks = classes(bodies, docs) if hot else codec.answer(list(zip(bodies, docs)))
        keep, body = [], []
        for i, (which, mask) in enumerate(zip(table.column("which").to_pylist(), masks)):
            hit = mask > 0
            if hit.any():
                keep.append(i)
                body.append((b"w" if hot else b"i") + squeeze(np.frombuffer(expand(which), dtype="<u4")[hit].tobytes() + mask[hit].astype("<u8").tobytes()))
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())).combine_chunks(), "masks": pa.array(body, pa.binary())})

    def known(*more: DataFrame) -> DataFrame:
        out = blocks
        for table in more:
            out = out.join(table.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"), "left").drop("_block")
        return out

    sent = known(shared_hashes).select("block", "ids", "sizes", "data", "hashes", "hot").mapInArrow(send, "target int, block long, which binary, docs binary, body binary")
    masks = sent.groupBy("target").applyInArrow(resolve, "block long, masks binary").groupBy("block").agg(F.collect_list("masks").alias("masks"))
    masks = materialize(masks, "masks")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, symbols, at, parts, s = surviving(batch, k)
                starts = [np.zeros(0, np.int64)]
                later = text.ids[s.items.doc] != s.smallest[s.of]  # an equal item of this block has a smaller id
                length = (s.items.high - s.items.low + 1)[later]
                starts.append(np.repeat(s.items.low[later], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)))
                w = hot_windows(s, symbols, width) if s.hot.any() else None
                mask, taken = np.zeros(len(s.first), dtype=np.uint64), np.zeros(len(w.left) if w else 0, dtype=bool)
                for body in batch.column("masks")[k].as_py() or ():
                    kind, body = body[:1], expand(body[1:])
                    n = len(body) // 12
                    which = np.frombuffer(body, dtype="<u4", count=n)
                    if kind == b"w":
                        taken[which] = True
                    else:
                        mask[which] = np.frombuffer(body, dtype="<u8", offset=4 * n)
                if w:  # windows of hot contents, in every item that has them
                    starts.append(_hot_starts(s, w, taken, text.ids))
                own = np.flatnonzero(~later & (mask[s.of] > 0))
                for d in range(width - seed + 1):
                    hit = own[(mask[s.of[own]] >> np.uint64(d)) & np.uint64(1) > 0]
                    starts.append(s.items.anchor[hit] - d)
                count = np.bincount(np.concatenate(starts), minlength=int(at[-1]) + 1)
                change = count.copy()
                change[width:] -= count[:-width]
                covered = np.cumsum(change[:-1]) > 0
                null = np.frombuffer(batch.column("nulls")[k].as_py(), dtype=bool)
                yield finish(text, parts, at, covered, null)

    out = known(shared_hashes, masks).select("block", "ids", "nulls", "sizes", "data", "hashes", "hot", "masks")
    return out.mapInArrow(close, schema)
