"""How far the sources of each language lie apart: exact triangular divergences of their term counts.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps the terms that at
least ``min_docs`` of its documents hold. With ``count`` occurrences of a kept term in a group (a language's source, or the
whole language), ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, where N sums the counts and V counts the kept terms, and two
groups differ at a term by ``f(p, q) = floor((p - q)**2 / (p + q))``. All arithmetic is on whole numbers, so no order of sums matters.

Method. A heavy-light split of the kept terms. Two groups without a term differ by one number, whatever the term: the sum starts as
V times that number. Terms that at least ``heavy_share`` of a language's sources hold are laid out as dense tiles (terms x sources)
and add what they differ from it. Of the other terms only the postings are visited: a term in one group of a pair adds a correction that
depends on its count alone (so equal counts are taken once), and a term in both adds a second one. Both partial sums are exact.

Size. Occurrences are combined per input partition (in pools of ``pool_tokens``) before they are shuffled once, by language and term;
no task holds a source, a language or a term's documents. Pairs are summed by tiles of about ``tile_rows`` postings and blocks of
``block`` sources, so a task holds a tile and ``4 * block**2`` sums, whatever the number of sources.

Edge cases. Null text, language or source is the empty string. Texts without a term, and languages without a kept one, still make their
group known: its pairs have value 0 if nothing is kept. A language's only source has no pair. Repeated rows are documents like any others; ids
are not read. Ties go by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not read. Very long texts are read
whole. Terms of one pool are told apart by 64 bits of hash, terms of different pools by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm.packing import chunks
from emberlane.llm.scratch import materialize, side_of
from emberlane.llm.wordhash import buffers, hash_spans, mix, trim, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[65:91] = NO_TERM[97:123] = NO_TERM[128:] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)


def spans_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of a buffer as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes()))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run of them starts in it."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.flatnonzero(new)


class Pool:
    """Term counts of some documents; ``flush`` combines them by group and term."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.groups: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.terms: list[pa.Array] = []
        self.size = 0
        self.number: dict[tuple[str, str], int] = {}

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        data, at = buffers(texts)
        data = LOWER[data]
        start, end, first = words(data, at, NO_TERM)
        if not len(start):
            return
        h = hash_spans(data, start, end)
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
        order, at = runs(mix(h + (doc + np.uint64(1)) * _ODD))  # a document's occurrences of a term
        one = order[at]
        group = np.array([self.number.setdefault(g, len(self.number)) for g in zip(langs, sources)], dtype=np.uint64)
        self.hashes.append(h[one])
        self.groups.append(group[doc[one].astype(np.int64)])
        self.counts.append(np.diff(np.append(at, len(order))))
        # each term's text once a chunk
        order, at = runs(h[one])
        self.terms.append((h[one][order[at]], spans_of(data, start[one][order[at]], end[one][order[at]])))
        self.size += len(one)

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        h, group, n = np.concatenate(self.hashes), np.concatenate(self.groups), np.concatenate(self.counts)
        order, at = runs(mix(h + (group + np.uint64(1)) * _ODD))
        n, docs = np.add.reduceat(n[order], at), np.diff(np.append(at, len(order)))
        one = order[at]
        known, text = np.concatenate([x for x, _ in self.terms]), pa.chunked_array([x for _, x in self.terms])
        order, at = runs(known)
        text = text.take(pa.array(order[at])).combine_chunks()
        term = text.take(pa.array(np.searchsorted(known[order[at]], h[one])))
        names = list(self.number)
        group = group[one].astype(np.int64)
        take = lambda k: pa.array([g[k] for g in names], pa.string()).take(pa.array(group))
        self.clear()
        return pa.RecordBatch.from_arrays([take(0), take(1), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, pool_tokens: int) -> DataFrame:
    """``lang, source, term, n, docs`` of ``lang, source, text``: occurrences and documents, combined pool by pool."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool()
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for part in chunks(texts):
                pool.add(texts[part.start : part.stop], langs[part.start : part.stop], sources[part.start : part.stop])
                if pool.size >= pool_tokens:
                    yield from _cut(pool.flush())
        yield from _cut(pool.flush())
        trim()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _cut(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    for s in range(0, batch.num_rows if batch else 0, 50_000):
        yield batch.slice(s, 50_000)


def share(n: str, total: str, vocab: str) -> Column:
    """``1 + floor(10**9 * (n + 2) / (total + 2 * vocab))``, exact beyond 64 bits."""
    return F.expr(f"1 + (1000000000 * CAST({n} + 2 AS DECIMAL(20, 0))) div ({total} + 2 * {vocab})")


def differ(p, q):
    """f, of whole numbers up to 10**9 + 1, elementwise."""
    return (p - q) ** 2 // (p + q)


_CELLS = 1 << 20


def pair_sums(row: np.ndarray, term: np.ndarray, p: np.ndarray, heavy: np.ndarray, p0: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the postings ``(row, term, p)`` of one tile add to the sum of each pair of rows, beyond f of their ``p0``.

    ``left`` and ``right`` tell which rows are paired: pairs of a left with a right row count. Symmetric.
    """
    n = len(p0)
    none = differ(p0[:, None], p0[None, :])
    out = np.zeros((n, n), dtype=np.int64)
    # heavy terms: dense tiles
    r, t, v = row[heavy], term[heavy], p[heavy]
    names, t = np.unique(t, return_inverse=True)
    tall = max(1, _CELLS // max(n, 1))
    order = np.argsort(t, kind="stable")
    r, t, v = r[order], t[order], v[order]
    for s in range(0, len(names), tall):
        lo, hi = np.searchsorted(t, [s, s + tall])
        tile = np.repeat(p0[None, :], min(tall, len(names) - s), axis=0)
        tile[t[lo:hi] - s, r[lo:hi]] = v[lo:hi]
        for i in np.flatnonzero(left):
            with_i = differ(tile[:, i, None], tile[:, right]) - none[i, right]
            out[i, right] += with_i.sum(axis=0)
    # light terms: in one row of the pair
    r, t, v = row[~heavy], term[~heavy], p[~heavy]
    alone = np.zeros((n, n), dtype=np.int64)
    kinds, many = np.unique(np.stack([r, v]), axis=1, return_counts=True) if len(r) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    step = max(1, _CELLS // max(n, 1))
    for s in range(0, len(many), step):
        i, w, k = kinds[0, s : s + step], kinds[1, s : s + step], many[s : s + step]
        np.add.at(alone, i, (differ(w[:, None], p0[None, :]) - none[i]) * k[:, None])
    out += np.where(left[:, None] & right[None, :], alone + alone.T, 0)
    # light terms: in both rows
    order = np.lexsort((r, t))
    r, t, v = r[order], t[order], v[order]
    for k in range(1, len(r)):
        both = np.flatnonzero(t[k:] == t[:-k])
        if not len(both):
            break
        for s in range(0, len(both), _CELLS):
            i = both[s : s + _CELLS]
            a, b, x, y = r[i], r[i + k], v[i], v[i + k]
            more = differ(x, y) - differ(x, p0[b]) - differ(p0[a], y) + none[a, b]
            # sums of at most 2**20 numbers below 2**32 are exact in doubles
            total = np.bincount(a * n + b, weights=more, minlength=n * n).astype(np.int64).reshape(n, n)
            out += np.where(left[:, None] & right[None, :], total + total.T, 0)
    return out


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """All pairs of sources of one block pair and one tile; see :func:`pair_sums`."""
    lang, a, b, tile = (x.as_py() for x in key)
    own = table.filter(pc.is_valid(table["vocab"])).sort_by("idx")
    idx, p0 = own["idx"].to_numpy(), own["p"].to_numpy()
    posting = table.filter(pc.is_null(table["vocab"]))
    row = np.searchsorted(idx, posting["idx"].to_numpy())
    block = own["block"].to_numpy()
    left, right = block == a, block == b
    out = pair_sums(row, posting["term"].to_numpy(), posting["p"].to_numpy(), posting["heavy"].to_numpy(zero_copy_only=False).astype(bool), p0, left, right)
    if tile == 0:
        out = out + own["vocab"].to_numpy()[:, None] * differ(p0[:, None], p0[None, :])
    i, j = np.nonzero(left[:, None] & right[None, :])
    i, j = (i[i < j], j[i < j]) if a == b else (i, j)
    names, value = own["source"].combine_chunks(), out[i, j]
    i, j = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    trim()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(i), "item": names.take(j), "value": pa.array(np.concatenate([value, value]), pa.int64())})


def audit_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 10,
    top: int = 10,
    heavy_share: float = 0.5,
    block: int = 256,
    tile_rows: int = 1 << 19,
    pool_tokens: int = 2_000_000,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: the distance of each source to each other one of its language (``pair``), and the ``top`` terms by which it exceeds the language (``term``)."""
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = term_counts(base, pool_tokens).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    held = counted.withColumn("n_docs", F.sum("docs").over(of_term)).where(F.col("n_docs") >= min_docs)
    held = held.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("n_term"), F.count(F.lit(1)).over(of_term).alias("n_groups"), (F.col("source") == F.min("source").over(of_term)).alias("leads"))
    held = materialize(held, "held")
    langs = held.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("leads").alias("vocab"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    in_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = base.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("n_group"), zero("n_lang"), zero("vocab"), (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(in_lang).alias("n_sources"))
    groups = materialize(groups.withColumn("block", F.expr(f"idx div {block}")).withColumn("n_blocks", F.expr(f"(n_sources + {block - 1}) div {block}")), "groups")
    known = held.join(side_of(groups), ["lang", "source"]).withColumn("p", share("n", "n_group", "vocab"))

    # pairs: postings and groups go to each block pair of their own block
    tiles = max(1, -(-held.count() // tile_rows))
    empty = lambda kind: F.lit(None).cast(kind)
    postings = known.select("lang", "idx", "block", "n_blocks", empty("string").alias("source"), F.xxhash64("term").alias("term"), "p", empty("long").alias("vocab"), (F.col("n_groups") >= heavy_share * F.col("n_sources")).alias("heavy"), F.expr(f"pmod(xxhash64(term, 1), {tiles}L)").alias("tile"))
    sides = groups.select("lang", "idx", "block", "n_blocks", "source", empty("long").alias("term"), F.coalesce(share("0", "n_group", "nullif(vocab, 0)"), F.lit(1)).cast("long").alias("p"), "vocab", empty("boolean").alias("heavy"), F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("tile"))
    both = postings.unionByName(sides).withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    both = both.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "tile", "idx", "block", "source", "term", "p", "vocab", "heavy")
    summed = both.groupBy("lang", "a", "b", "tile").applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    over = known.withColumn("q", share("n_term", "n_lang", "vocab")).where("p > q")
    terms = over.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", place).select(*columns).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top).select(*columns))
