"""Substring dedup by seed and extend: repeats of 13 words across documents.

Method. Documents are joined on winnowed anchors of ``SEED`` words (see :mod:`emberlane.llm.seedextend`).
Where an anchor occurs in two documents, its surroundings meet in one place and are extended word by
word, to the right and to the left, into classes of equal text; extensions of at least ``WIDTH`` words
are repeats, and their unions in a document are its maximal repeats. Members of a class are compared with
its smallest document, never pair by pair.

Result. A word goes if a window of ``WIDTH`` words that covers it also starts in a document with a smaller
id, judged on the input. What stays is joined by single spaces.

Edge cases. Words are runs of anything but ASCII white space, unchanged. Null text has no words. Null ids
count as larger than all others and as equal among themselves. Documents with equal ids (repeated rows)
never remove each other's words. Documents under ``WIDTH`` words stay whole. An empty table gives no
rows. Other columns are not read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlane.llm import seedextend, wordhash
from emberlane.llm.seedextend import Codec, Items, Text

WIDTH, SEED = 13, 5
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _symbols(text: Text) -> tuple[np.ndarray, np.ndarray, tuple]:
    start, end, first = wordhash.words(text.data, text.at)
    return wordhash.hash_spans(text.data, start, end), first, (start, end)


def _encode(text: Text, parts: tuple, items: Items, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, bytes]:
    start, end = parts
    at = first[which]
    anchor, low, high = items.anchor[at], items.low[at], items.high[at]
    data = text.data
    texts = [data[s:e].tobytes() for s, e in zip(start[low].tolist(), end[high + WIDTH - 1].tolist())]
    head = np.concatenate([anchor - high, anchor - low]).astype(np.uint8).tobytes()
    return which, len(at).to_bytes(4, "little") + seedextend.squeeze(head + b"\n".join(texts), 3)


def _answer(pieces: list[tuple[bytes, np.ndarray]]) -> list[np.ndarray]:
    d0, d1, texts = [], [], []
    for body, _ in pieces:
        n = int.from_bytes(body[:4], "little")
        raw = seedextend.expand(body[4:])
        head = np.frombuffer(raw[: 2 * n], dtype=np.uint8).astype(np.int64)
        d0.append(head[:n])
        d1.append(head[n:])
        texts.append(raw[2 * n :])
    base = np.concatenate([[0], np.cumsum([len(x) for x in d0])])
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    start, end, _ = wordhash.words(data, np.array([0, len(data)]))
    word = wordhash.hash_spans(data, start, end)
    d0, d1, docs = np.concatenate(d0), np.concatenate(d1), np.concatenate([p[1] for p in pieces])
    anchor = np.concatenate([[0], np.cumsum(d1 - d0 + WIDTH)])[:-1] + d1
    step = np.uint64(0x9E3779B97F4A7C15)
    right = np.zeros((WIDTH + 1, len(d0)), dtype=np.uint64)
    for r in range(WIDTH):  # extend to the right
        has = np.flatnonzero(r < WIDTH - d0)
        right[r + 1, has] = wordhash.mix(right[r, has] * step + word[anchor[has] + r])
    left = np.zeros(len(d0), dtype=np.uint64)
    mask = np.zeros(len(d0), dtype=np.uint64)
    for d in range(WIDTH - SEED + 1):  # and to the left
        if d:
            has = np.flatnonzero(d1 >= d)
            left[has] = wordhash.mix(left[has] * step + word[anchor[has] - d])
        here = np.flatnonzero((d0 <= d) & (d <= d1))
        if not len(here):
            continue
        order, cut = seedextend._groups(wordhash.mix(right[WIDTH - d, here] * step + left[here]))
        size = np.diff(np.append(cut, len(order)))
        who = docs[here[order]]
        mask[here[order[who > np.repeat(np.minimum.reduceat(who, cut), size)]]] |= np.uint64(1 << d)
    return [mask[s:e] for s, e in zip(base[:-1], base[1:])]


def _finish(text: Text, parts: tuple, at: np.ndarray, covered: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    data = text.data.tobytes()
    gone = np.concatenate([[0], np.cumsum(covered)])
    removed = gone[at[1:]] - gone[at[:-1]]
    kept, spans = [], []
    for k, (s, e) in enumerate(zip(text.at[:-1].tolist(), text.at[1:].tolist())):
        words = data[s:e].split()
        if removed[k]:
            c = covered[at[k] : at[k + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
            words = compress(words, (~c).tolist())
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    return pa.RecordBatch.from_arrays(
        [pa.array(text.ids, mask=null), pa.array(np.diff(at)), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "spans", "kept"],
    )


CODEC = Codec(WIDTH, SEED, _symbols, _encode, _answer)


def dedup_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, target_bytes: int = 2 << 20, hot_items: int = 1 << 16) -> DataFrame:
    """``doc_id, n_words, n_removed, spans`` (removed word ranges, maximal) and ``kept`` of every row."""
    return seedextend.repeated_windows(docs, CODEC, _finish, SCHEMA, id_col=id_col, text_col=text_col, block_bytes=block_bytes, target_bytes=target_bytes, hot_items=hot_items)
