"""Benchmark decontamination by spaced seeds.

Method. Tokens are lower-case runs of letters and digits. A seed is the hash of the tokens that a fixed
mask selects in a stretch of text; what the mask leaves out may differ. Seeds of the benchmark and of a
document are joined by their hash, and around each hit the document and the item are laid side by side
without gaps. An overlap is a stretch of ``WINDOW`` tokens of which at most ``SUBSTITUTIONS`` differ, or a whole
item that is shorter, of which as many differ in proportion (:func:`tolerance`). The masks together hit every such
stretch, whichever tokens differ, so none is missed; an item shorter than a window has masks of its own length, which
leave out parts of it.

A benchmark of at most ``BLOCK_TOKENS`` tokens is broadcast, and the join is a lookup where the documents
are, in one stage without a shuffle. A larger one stays a table: its seeds are joined with those seeds of the
documents that a bitmap lets through (some 16 cells a seed, up to 2**30 cells; it is put together by the executors), and
only documents with a hit meet the items hit. Both ways find the same.

Edge cases. Null texts have no tokens and overlap nothing. Items under ``shortest`` tokens overlap nothing: by default every
item is compared; to drop documents, items under ``SHORTEST`` tokens are no evidence (:func:`drop_contaminated`).
Very long texts are read whole. Equal hits on an item are one span, whatever their order. Null ids stay null.
Repeated rows each get a row; repeated items are all named. Empty tables on either side work. Other columns
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.packing import chunks
from emberlane.llm.scratch import materialize, side_of, text_key, without_rows
from emberlane.llm.wordhash import buffers, hash_spans, mix, trim, words

WINDOW, SUBSTITUTIONS, SHORTEST = 13, 3, 8
BLOCK_TOKENS = 1_000_000
#: Fixed masks, 1 = compared. Every 13 tokens with 3 differing hold a stretch that one of them passes.
MASKS = ("11101011", "1100100111", "111111", "1011000111", "1110001011", "1110111", "11101101")

#: Cells of the bitmap for a seed, and the most bits of their number.
_CELLS, _MOST_BITS, _SEGMENT = 16, 30, 20
_COEF = np.random.default_rng(31).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOOM = 22


def _gaps() -> np.ndarray:
    gap = np.zeros(256, dtype=bool)
    gap[:128] = True
    for a, b in ((48, 58), (97, 123)):
        gap[a:b] = False
    return gap


GAP = _gaps()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the tokens of lower-case texts, and the first token of each text."""
    data, at = buffers(texts)
    data = data.copy()
    lead = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0) & (data[1:] >= 0xA0)) if len(data) > 1 else np.zeros(0, np.int64)
    data[lead] = 32  # Latin-1 signs and the no-break space
    data[lead + 1] = 32
    wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    for k in range(3):  # dashes, quotes and other general punctuation
        data[wide + k] = 32
    s, e, first = words(data, at, GAP)
    return hash_spans(data, s, e), s, e, first


def seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The seed that starts at each token where the whole span fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, dtype=np.uint64)
    for j in mask:
        out += h[j : j + n] * _COEF[j]
    return mix(out)


def tolerance(n: int) -> int:
    """How many tokens of a window, or of an item of ``n`` tokens, may differ."""
    return SUBSTITUTIONS * min(n, WINDOW) // WINDOW


Mask = tuple[int, tuple[int, ...], int]


def all_masks(shortest: int) -> list[Mask]:
    """The masks with their salts, and the length of the items that they are for (0: those that hold a window).

    A short item of which k tokens may differ is cut into k + 2 parts; its masks leave out k of them, in all ways.
    """
    out = [(salt, tuple(i for i, c in enumerate(m) if c == "1"), 0) for salt, m in enumerate(MASKS)]
    for n in range(max(1, shortest), WINDOW):
        k = tolerance(n)
        parts = np.array_split(np.arange(n), k + 2 if k else 1)
        for j, kept in enumerate(itertools.combinations(parts, len(parts) - k)):
            out.append((100 + 16 * n + j, tuple(np.concatenate(kept).tolist()), n))
    return out


class Block:
    """Part of the benchmark: its tokens and its seeds in sorted order."""

    def __init__(self, ids: list, texts: list[str], shortest: int):
        self.hash, _, _, self.at = tokens(pa.array(texts, pa.string()))
        self.ids = ids
        n = np.diff(self.at)
        item = np.repeat(np.arange(len(ids)), n)
        pos = np.arange(len(self.hash)) - np.repeat(self.at[:-1], n)
        lengths = {0, *n.tolist()}
        self.masks = [m for m in all_masks(shortest) if m[2] in lengths]
        keys, at, items, salts = [], [], [], []
        for salt, m, length in self.masks:
            k = seeds(self.hash, m, salt)
            i = np.arange(len(k))
            own = (n[item[i]] == length) & (pos[i] == 0) if length else n[item[i]] >= WINDOW
            ok = (item[i] == item[i + m[-1]]) & own
            keys.append(k[ok])
            at.append(pos[i[ok]].astype(np.int32))
            items.append(item[i[ok]].astype(np.int32))
            salts.append(np.full(len(keys[-1]), salt, dtype=np.int32))
        self.key, self.pos, self.item, self.salt = (np.concatenate(x) for x in (keys, at, items, salts))
        order = np.argsort(self.key, kind="stable")
        self.key, self.pos, self.item, self.salt = self.key[order], self.pos[order], self.item[order], self.salt[order]
        self.bloom = np.zeros(1 << _BLOOM, dtype=bool)
        self.bloom[(self.key >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first token, end token) of every overlap; tokens count from the buffer's first."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for p, lo, hi, text in self._hits(h, first):
            by_key = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (text[1:] != text[:-1])]))
            for s, e in zip(by_key.tolist(), [*by_key[1:].tolist(), len(p)]):
                a, b = int(lo[s]), int(hi[s])
                cut = np.flatnonzero(np.concatenate([[True], self.item[a + 1 : b] != self.item[a : b - 1]])).tolist()
                for x, y in zip(cut, [*cut[1:], b - a]):
                    found.setdefault((int(text[s]), int(self.item[a + x])), []).append(_differences(p[s:e], self.pos[a + x : a + y]))
        out = []
        for (t, i), parts in found.items():
            item = self.hash[self.at[i] : self.at[i + 1]]
            spans = [x for d in np.unique(np.concatenate(parts)).tolist() for x in _spans(h, item, d, int(first[t]), int(first[t + 1]))]
            out += [(t, i, s, e) for s, e in _union(spans)]
        return sorted(out)

    def _hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """Per mask: the tokens where a seed of the benchmark starts, where that lies in the table, and the text; ordered by seed."""
        for salt, m, _ in self.masks:
            k = seeds(h, m, salt)
            at = np.flatnonzero(self.bloom[(k >> np.uint64(64 - _BLOOM)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, k[at], "left"), np.searchsorted(self.key, k[at], "right")
            text = np.searchsorted(first, at, side="right") - 1
            ok = (hi > lo) & (at + m[-1] < first[text + 1])
            at, lo, hi, text = at[ok], lo[ok], hi[ok], text[ok]
            if len(at):
                order = np.lexsort((at, lo, text))
                yield at[order], lo[order], hi[order], text[order]


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct values of ``p[i] - q[j]``; of long lists by a convolution of their marks, not pair by pair."""
    low, high = int(p[0]) - int(q[-1]), int(p[-1]) - int(q[0])
    if len(p) * len(q) <= max(1 << 16, 4 * (high - low)):
        return np.unique(p[:, None] - q[None, :])
    a, b = np.zeros(int(p[-1] - p[0]) + 1), np.zeros(int(q[-1] - q[0]) + 1)
    a[p - p[0]] = 1
    b[q[-1] - q] = 1
    n = 1 << (high - low + 1).bit_length()
    return low + np.flatnonzero(np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[: high - low + 1] > 0.5)


def _spans(h: np.ndarray, item: np.ndarray, d: int, start: int, stop: int) -> list[tuple[int, int]]:
    """The overlaps of a text (tokens ``start`` to ``stop``) with an item that is laid at token ``d``."""
    lo, hi = max(d, start), min(d + len(item), stop)
    equal = h[lo:hi] == item[lo - d : hi - d]
    if len(item) < WINDOW:
        at = np.flatnonzero(equal)  # without what differs at either end
        return [(lo + int(at[0]), lo + int(at[-1]) + 1)] if hi - lo == len(item) and len(item) - len(at) <= tolerance(len(item)) else []
    differ = np.concatenate([[0], np.cumsum(~equal)])
    good = np.flatnonzero(differ[WINDOW:] - differ[:-WINDOW] <= SUBSTITUTIONS)
    if not len(good):
        return []
    out = []
    for g in np.split(good, np.flatnonzero(np.diff(good) > WINDOW) + 1):
        at = np.flatnonzero(equal[g[0] : g[-1] + WINDOW]) + g[0]  # without what differs at either end
        out.append((lo + int(at[0]), lo + int(at[-1]) + 1))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = "struct<item:long,start:long,end:long>"
SCHEMA = f"doc_id long, text_key long, items array<long>, spans array<{_SPAN}>, n_tokens long"


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = 1, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Per document: ``doc_id, text_key, items`` (ids of the items found, sorted), ``spans`` (token ranges) and ``n_tokens``.

    Spans count the document's tokens, and those of an item neither overlap nor touch; ``n_tokens`` is how many tokens all
    spans cover together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(f"`{text_col}`").alias("text_key"), F.lower(F.col(text_col).cast("string")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("item")).distinct()
    size = items.agg(F.sum(F.length("item") / 2 + 1)).first()[0] or 0
    if size <= block_tokens:
        got = items.collect()  # bounded by the line above
        return _looked_up(rows, docs.sparkSession.sparkContext.broadcast(Block([r[0] for r in got], [r[1] for r in got], shortest)))
    return _joined(rows, items, shortest)


def _result(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    """Rows of ``SCHEMA`` for a batch that starts with ``doc_id, text_key``; ``found`` is (row, item id, start, end)."""
    items: list[list] = [[] for _ in range(len(batch))]
    spans: list[list] = [[] for _ in range(len(batch))]
    for k, i, s, e in found:
        items[k].append(i)
        spans[k].append({"item": i, "start": s, "end": e})
    items = [sorted(set(x), key=lambda v: (v is not None, v)) if x else x for x in items]
    n = [sum(e - s for s, e in _union([(y["start"], y["end"]) for y in x])) for x in spans]
    spans = [sorted(x, key=lambda y: (y["item"] is not None, y["item"], y["start"])) if len(x) > 1 else x for x in spans]
    kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(spans, kind), pa.array(n, pa.int64())], names=["doc_id", "text_key", "items", "spans", "n_tokens"])


def _looked_up(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            found = []
            for part in chunks(batch.column(2), 4_000_000):
                h, _, _, first = tokens(batch.column(2)[part.start : part.stop])
                found += [(part.start + t, block.ids[i], s - int(first[t]), e - int(first[t])) for t, i, s, e in block.overlaps(h, first)]
            yield _result(batch, found)
        trim()

    return rows.mapInArrow(run, SCHEMA)


def _bitmap(table: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the leading ``bits`` of a seed that occurs; executors mark segments of 2**20 cells, which come as bytes."""
    width = min(bits, _SEGMENT)

    def mark(part: pa.Table) -> pa.Table:
        cell = part["cell"].to_numpy()
        marks = np.zeros(1 << width, dtype=np.uint8)
        marks[cell & ((1 << width) - 1)] = 1
        return pa.table({"segment": pa.array([int(cell[0]) >> width], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    cells = table.select(F.shiftrightunsigned("seed", 64 - bits).alias("cell")).distinct()
    found = cells.groupBy(F.shiftright("cell", width).alias("segment")).applyInArrow(mark, "segment long, marks binary").collect()  # 2**10 at most
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << width) // 8
    for r in found:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["marks"], dtype=np.uint8)
    return out


def _joined(rows: DataFrame, items: DataFrame, shortest: int) -> DataFrame:
    """The same for a benchmark of any size, by a join of seeds."""
    items = materialize(items.withColumn("item_key", F.xxhash64("item", "item_id")), "items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1), 1_000_000):
                block = Block([None] * len(part), batch.column(1)[part.start : part.stop].to_pylist(), shortest)
                who = batch.column(0).take(pa.array(block.item.astype(np.int64) + part.start))
                yield pa.RecordBatch.from_arrays([who, pa.array(block.key.view(np.int64)), pa.array(block.salt)], names=["item_key", "seed", "salt"])

    table = materialize(items.select("item_key", "item").mapInArrow(item_seeds, "item_key long, seed long, salt int").distinct(), "seeds")
    used = {r[0] for r in table.select("salt").distinct().collect()}  # one of some fifty masks each
    masks = [m for m in all_masks(shortest) if m[0] in used]
    bits = min(_MOST_BITS, max(16, (_CELLS * table.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(table, bits))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for part in chunks(batch.column(2), 1_000_000):
                h, _, _, first = tokens(batch.column(2)[part.start : part.stop])
                for salt, m, _ in masks:
                    k = seeds(h, m, salt)
                    cell = (k >> np.uint64(64 - bits)).astype(np.int64)
                    at = np.flatnonzero(marks[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                    text = np.searchsorted(first, at, side="right") - 1
                    ok = at + m[-1] < first[text + 1]
                    who = pa.array(text[ok] + part.start)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(k[at[ok]].view(np.int64))], names=["doc_id", "text_key", "seed"])

    hits = rows.mapInArrow(doc_seeds, "doc_id long, text_key long, seed long").distinct().join(table, "seed")
    pairs = materialize(hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "item_key").distinct(), "pairs")
    met = rows.join(side_of(pairs), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["_id", "_key", "item_key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(len(batch)):
                block = Block([batch.column(3)[k].as_py()], [batch.column(4)[k].as_py()], shortest)
                h, _, _, first = tokens(batch.column(2)[k : k + 1])
                found += [(k, block.ids[i], s, e) for _, i, s, e in block.overlaps(h, first)]
            yield _result(batch, found)

    each = met.join(items, "item_key").select("doc_id", "text_key", "text", "item_id", "item").mapInArrow(verify, SCHEMA)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, [(k, y["item"], y["start"], y["end"]) for k, x in enumerate(batch.column(2).to_pylist()) for y in x])

    found = each.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(gather, SCHEMA)
    found = materialize(found.where("n_tokens > 0"), "overlaps").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "items", "spans", "n_tokens")
    out = rows.select("doc_id", "text_key").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    nothing = lambda kind: F.array().cast(kind)
    return out.select("doc_id", "text_key", F.coalesce("items", nothing("array<long>")).alias("items"), F.coalesce("spans", nothing(f"array<{_SPAN}>")).alias("spans"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item of at least ``shortest`` tokens; each row's own text decides, whatever ids it shares."""
    found = find_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, shortest=shortest, **options)
    return without_rows(docs, found.where(F.size("items") > 0), id_col, text_col)
