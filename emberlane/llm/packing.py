"""Packing: sum-of-squares online placement of tokenised documents into windows.

Method. Every input partition packs its own documents, so no row is shuffled. A document's ids (and one
end id) are cut into full windows and a rest; the rest goes to the fill level that makes the sum of the
squared counts of partly filled windows smallest, found in an array that counts the windows at each
level. When a partition ends the open windows are poured together: pieces are cut
so that all but one window are full. (So they are if they hold more than ``max_held`` ids, which guards
memory: 128 MB by default, more than the ids of a whole input partition of Spark's usual size.) The last
window of a partition is cut into windows whose lengths are powers of two, which need no padding.

Tokens. Each worker encodes a piece of text once (:mod:`emberlane.llm.tokens`).

Edge cases. Null text is empty and gives the end id alone. Null ids, repeated rows and equal texts are
packed like any others. An empty table gives no rows. Texts of any length stream through; only the open
windows and the document at hand are held. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from emberlane.llm.tokens import PieceEncoder
from emberlane.llm.wordhash import trim

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[int, PieceEncoder] = {}


class Packer:
    """Sum-of-squares state of one partition; finished pieces gather in ``rows``."""

    def __init__(self, capacity: int, first_sequence: int, max_held: int):
        self.capacity, self.next, self.max_held = capacity, first_sequence, max_held
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = self.held = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, c = len(ids), self.capacity
        full = total - total % c
        for s in range(0, full, c):
            self.close([(doc, s, ids[s : s + c], total)])
        if full < total:
            self.place((doc, full, ids[full:], total))

    def best(self, s: int) -> int:
        """The fill level to which a piece of ``s`` ids goes; 0 opens a window."""
        c, n = self.capacity, self.level
        # change of the sum of squares if a window at level h goes to h + s; h = 0 opens a window
        after = 2 * n[s : c + 1] + 1
        after[-1] = 0  # a full window is no longer counted
        before = 2 * n[: c - s + 1] - 1
        before[0] = 0
        cost = np.where(n[: c - s + 1] > 0, after - before, np.iinfo(np.int64).max)
        cost[0] = after[0]
        return c - s - int(np.argmin(cost[::-1]))  # of equal levels the fullest

    def place(self, piece: tuple) -> None:
        c, s, n = self.capacity, len(piece[2]), self.level
        h = self.best(s)
        window = []
        if h:
            stack = self.open[h]
            window = stack.pop()
            n[h] -= 1
            self.n_open -= 1
            self.held -= h
        window.append(piece)
        if h + s == c:
            self.close(window)
            return
        self.open.setdefault(h + s, []).append(window)
        n[h + s] += 1
        self.n_open += 1
        self.held += h + s
        if self.held > self.max_held:
            self.pour(False)

    def pour(self, last: bool) -> None:
        """Cut the pieces of all open windows into full ones; what is left stays open, or ends in powers of two."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open, self.held = {}, 0, 0
        self.level[:] = 0
        left = sum(len(p[2]) for w in windows for p in w)
        room = self._room(left, last)
        now: list = []
        for doc, start, ids, total in (p for w in windows for p in w):
            while len(ids):
                take = min(room, len(ids))
                now.append((doc, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    self.close(now)
                    now, room = [], self._room(left, last)
        if now:
            fill = sum(len(p[2]) for p in now)
            self.open, self.n_open, self.held = {fill: [now]}, 1, fill
            self.level[fill] = 1

    def _room(self, left: int, last: bool) -> int:
        return self.capacity if left >= self.capacity or not last else 1 << max(0, left.bit_length() - 1)


def pack_documents(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, max_held: int = 1 << 25) -> DataFrame:
    """Pieces of all documents and the windows (``sequence_id``, ``offset``) that hold them.

    ``tokenizer_json`` is the tokenizer's definition; it is broadcast, as executors need not have the file.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    tail = np.array([end_id], dtype="<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, PieceEncoder(shared.value))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, max_held)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in chunks(texts, 1_000_000):
                tokens, sizes = encoder.encode(texts[part.start : part.stop])
                upto = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                for doc, s, e in zip(ids[part.start : part.stop], upto[:-1], upto[1:]):
                    packer.add(doc, np.concatenate([tokens[s:e], tail]))
                if len(packer.rows) > 5_000:
                    yield _rows(packer)
            trim()
        packer.pour(True)
        yield _rows(packer)
        del packer
        trim()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def chunks(texts: pa.Array, chars: int = 2_000_000) -> Iterator[range]:
    """Runs of rows of about so many bytes of text, one row at least."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield range(at, end)
        at = end


def _rows(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)
