"""Suffix-array dedup: repeats of 50 bytes across documents, by a distributed merge sort of suffixes.

Method. Blocks of documents sort the suffixes that start at their sampled anchors (see
:mod:`emberlane.llm.seedextend`; only anchors that occur in two documents are left) and send each target
its part of the sorted run, front-coded: of each suffix the length of the prefix it shares with the one
before, and the rest. A target merges the runs with a loser tree that keeps, with every loser, the length
of the prefix it is known to share with the last suffix put out; unequal lengths decide a match without
a look at the bytes, and equal ones are compared from there on. The merged run is the suffix array of the
anchors, its common prefixes come for free, and suffixes that share enough bytes to the right (an
interval of the array) and to the left are the equal windows.

Result. A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller
id, judged on the input.

Edge cases. Null text is empty. Null ids count as larger than all others and as equal among themselves.
Documents with equal ids (repeated rows) never remove each other's bytes. Texts shorter than ``width``
stay whole. Removing bytes may split a character, so ``kept`` is binary. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlane.llm import seedextend, wordhash
from emberlane.llm.seedextend import Codec, Items, Text

WIDTH, SEED = 50, 25
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _symbols(text: Text) -> tuple[np.ndarray, np.ndarray, None]:
    return text.data, text.at, None


def _encode(text: Text, _, items: Items, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, bytes]:
    at = first[which]
    anchor, low, high = items.anchor[at], items.low[at], items.high[at]
    end = high + WIDTH
    body = memoryview(text.data)
    rights = [bytes(body[a:e]) for a, e in zip(anchor.tolist(), end.tolist())]
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rights = [rights[i] for i in order]
    which, anchor, low, high = which[order], anchor[order], low[order], high[order]
    size = WIDTH - (anchor - high)
    share = np.zeros(len(rights), dtype=np.int64)
    if len(rights) > 1:
        joined = np.frombuffer(b"".join(r.ljust(WIDTH, b"\0") for r in rights), dtype=np.uint8).reshape(-1, WIDTH)
        differ = joined[1:] != joined[:-1]
        share[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        share[1:] = np.minimum(share[1:], np.minimum(size[1:], size[:-1]))
    rest = b"".join([r[k:] for r, k in zip(rights, share.tolist())])
    left = b"".join([bytes(body[s:a]) for s, a in zip(low.tolist(), anchor.tolist())])
    head = np.concatenate([share, size, anchor - high, anchor - low]).astype(np.uint8).tobytes()
    return which, len(rights).to_bytes(4, "little") + seedextend.squeeze(head + rest + left, 3)


def _suffixes(share: list[int], size: list[int], rest: bytes) -> Iterator[tuple[bytes, int]]:
    """A front-coded run, suffix by suffix, each with the prefix it shares with the one before."""
    at, last = 0, b""
    for k, n in zip(share, size):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last, k


def _mismatch(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix, known to be ``k`` at least."""
    n = min(len(a), len(b))
    while k + 8 <= n and a[k : k + 8] == b[k : k + 8]:
        k += 8
    while k < n and a[k] == b[k]:
        k += 1
    return k


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """``(run, shared prefix with the suffix before)`` in sorted order: a loser tree that reuses prefixes."""
    n = 1
    while n < len(runs):
        n *= 2
    text: list[bytes | None] = [None] * n
    known = [0] * n  # per run, the prefix its head shares with the last suffix put out
    for i, run in enumerate(runs):
        text[i] = next(run, (None, 0))[0]
    loser = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's known prefix then refers to the winner."""
        x, y = text[a], text[b]
        if x is None:
            return b, a
        if y is None or known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        if x == y:
            if a > b:
                a, b = b, a
            known[b] = len(y)
            return a, b
        k = _mismatch(x, y, known[a])
        if x[k:] < y[k:]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    best = list(range(n))
    level = n
    while level > 1:
        half = level // 2
        winners = []
        for i in range(half):
            w, x = play(best[2 * i], best[2 * i + 1])
            loser[half + i] = x
            winners.append(w)
        best, level = winners, half
    w = best[0]
    while text[w] is not None:
        yield w, known[w]
        head = next(runs[w], None)
        if head is None:
            text[w] = None
        else:
            text[w], known[w] = head
        node = (n + w) // 2
        while node:
            x = loser[node]
            y = text[x]
            if y is not None and (text[w] is None or known[x] >= known[w]):
                if text[w] is None or known[x] > known[w]:
                    loser[node], w = w, x
                else:
                    w, loser[node] = play(w, x)
            node //= 2


def _answer(pieces: list[tuple[bytes, np.ndarray]]) -> list[np.ndarray]:
    runs, d0, d1, left = [], [], [], []
    for body, _ in pieces:
        n = int.from_bytes(body[:4], "little")
        raw = seedextend.expand(body[4:])
        share, size, a, b = np.frombuffer(raw[: 4 * n], dtype=np.uint8).astype(np.int64).reshape(4, n)
        cut = 4 * n + int((size - share).sum())
        runs.append(_suffixes(share.tolist(), size.tolist(), raw[4 * n : cut]))
        d0.append(a)
        d1.append(b)
        left.append(raw[cut:])
    base = np.concatenate([[0], np.cumsum([len(a) for a in d0])])
    total = int(base[-1])
    run = np.zeros(total, dtype=np.int32)
    share = np.zeros(total, dtype=np.int64)
    for i, (w, k) in enumerate(merge_runs(runs)):
        run[i] = w
        share[i] = k
    # the i-th suffix put out is the next of its run
    by_run = np.argsort(run, kind="stable")
    item = np.zeros(total, dtype=np.int64)
    item[by_run] = np.arange(total)  # runs in order, each in its own order: the items' numbering
    d0, d1, docs = (np.concatenate(x)[item] for x in (d0, d1, [p[1] for p in pieces]))
    ends = np.cumsum(np.concatenate([x for x in [np.zeros(0, np.int64), d1[np.argsort(item)]]]))[item]
    bytes_left = np.frombuffer(b"".join(left), dtype=np.uint8)
    mask = np.zeros(total, dtype=np.uint64)
    back = np.zeros(total, dtype=np.uint64)  # hash of the bytes to the left, so far
    for d in range(WIDTH - SEED + 1):
        if d:
            has = np.flatnonzero(d1 >= d)
            back[has] = wordhash.mix(back[has] * np.uint64(0x9E3779B97F4A7C15) + bytes_left[ends[has] - d].astype(np.uint64) + np.uint64(1))
        here = np.flatnonzero((d0 <= d) & (d <= d1))
        if not len(here):
            continue
        interval = np.cumsum(share < WIDTH - d)[here].astype(np.uint64)
        key = wordhash.mix(interval * np.uint64(0xD1B54A32D192ED03) + back[here])
        order, cut = seedextend._groups(key)
        size = np.diff(np.append(cut, len(order)))
        smallest = np.repeat(np.minimum.reduceat(docs[here[order]], cut), size)
        hit = here[order[docs[here[order]] > smallest]]
        mask[hit] |= np.uint64(1 << d)
    out = np.zeros(total, dtype=np.uint64)
    out[item] = mask
    return [out[s:e] for s, e in zip(base[:-1], base[1:])]


def _finish(text: Text, _, at: np.ndarray, covered: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    kept = text.data[~covered]
    sums = np.concatenate([[0], np.cumsum(~covered)])[at]
    edge = covered.copy()
    edge[1:] &= ~covered[:-1]
    edge[at[:-1][at[:-1] < len(covered)]] = covered[at[:-1][at[:-1] < len(covered)]]
    start = np.flatnonzero(edge)
    stop = covered.copy()
    stop[:-1] &= ~covered[1:]
    last = at[1:][at[1:] > 0] - 1
    stop[last] = covered[last]
    end = np.flatnonzero(stop) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    counts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(at) - 1))])
    spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(start - at[doc]), pa.array(end - at[doc])], names=["start", "end"]))
    body = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(sums.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
    return pa.RecordBatch.from_arrays([pa.array(text.ids, mask=null), pa.array(np.diff(at)), spans, body], names=["doc_id", "n_bytes", "spans", "kept"])


CODEC = Codec(WIDTH, SEED, _symbols, _encode, _answer)


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, target_bytes: int = 2 << 20, hot_items: int = 1 << 16) -> DataFrame:
    """``doc_id, n_bytes, spans`` (removed byte ranges, maximal) and ``kept`` of every row."""
    return seedextend.repeated_windows(docs, CODEC, _finish, SCHEMA, id_col=id_col, text_col=text_col, block_bytes=block_bytes, target_bytes=target_bytes, hot_items=hot_items)
