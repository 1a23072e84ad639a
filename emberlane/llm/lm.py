"""Log-likelihood of whole documents under a recurrent language model, beside that of a unigram model.

Tokens are runs of bytes that are no white space, A-Z lower-cased, and one end for each document. Documents that may be learned from
are counted whole: ``c`` of each token, N tokens and V distinct ones.

Method. A gated recurrent network (:mod:`emberlane.llm.gru`) reads a document from its first to its last token; its state is carried from
window to window, so nothing is cut. The output softmax is factored by classes: the ``words`` commonest tokens fall into classes of
``width`` by frequency and are told apart within their class by the network; all others fall into 32 classes by their last two bytes, within which
a token has the probability (c + 0.5) / (sum of c + 0.5 * (types + 1)), an unknown one as if it were there with c = 0. The network starts as the unigram model and is
trained by truncated backpropagation: each of ``passes`` rounds trains a copy on each group of about ``group_tokens`` tokens, and the
copies are averaged, ``fan`` at a time. All tokens that may be learned from are read, by segments of ``segment`` tokens, unless ``sample_every`` asks
for a share of them (1 / ``sample_every``, at least ``least_tokens`` tokens); fewer tokens than ``least_tokens`` are read several times a round, at most eight.

Size. Tokens are combined per task before they are counted by a shuffle. The ``known`` commonest tokens' counts (at most ``known``) go to the
workers; what a document holds beyond those is joined with the counts by a shuffle, once per different text, so no
vocabulary is held whole. A task holds ``pool_tokens`` symbols (2 bytes each) besides the document at hand. Tokens are told apart by 59 bits of hash.

Edge cases. Null text is empty: its only token is the end. Null ids are not held out, and are learned from. Repeated rows count as often as they
are there. Nothing to learn from: both scores are those of N = V = 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm import gru
from emberlane.llm.divergence import LOWER, runs
from emberlane.llm.packing import chunks
from emberlane.llm.scratch import materialize
from emberlane.llm.wordhash import buffers, hash_spans, mix, trim, words

TAILS = 32
_END = np.uint64(0x5EED0E4D00000000)
_LOG10 = math.log(10)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's tokens and its end: hashes whose last five bits are the class by last two bytes, and each text's first."""
    data, at = buffers(texts)
    data = LOWER[data]
    start, end, first = words(data, at)
    h = hash_spans(data, start, end)
    if len(h):
        last = data[end - 1].astype(np.uint64) << np.uint64(8) | np.where(end - start > 1, data[end - 2], 0).astype(np.uint64)
        h = h & np.uint64(0xFFFFFFFFFFFFFFE0) | mix(last) & np.uint64(TAILS - 1)
    n = len(texts)
    out = np.empty(len(h) + n, dtype=np.uint64)
    begin = first + np.arange(n + 1)
    ends = begin[1:] - 1
    out[ends] = _END
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends] = False
    out[is_word] = h
    return out, begin


def _count(docs: DataFrame, pool_tokens: int) -> DataFrame:
    """``h, n`` of all tokens of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h = np.sort(np.concatenate(held))
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(at, len(h)))
                h = h[at].view(np.int64)
                held.clear()
                for s in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[s : s + 100_000]), pa.array(n[s : s + 100_000])], names=["h", "n"])

        for batch in batches:
            for part in chunks(batch.column(0)):
                held.append(tokens(batch.column(0)[part.start : part.stop])[0])
                size += len(held[-1])
                if size >= pool_tokens:
                    yield from flush()
                    size = 0
        yield from flush()
        trim()

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest tokens: sorted hashes, their counts, and the symbol of each (or that of its tail)."""

    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    words: int

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token stands among the keys, and whether it is there. Keys lie by their leading bits, which are a hash's, about one a slot."""
        if not hasattr(self, "_slots"):
            bits = min(24, max(1, len(self.keys).bit_length()))
            self._shift = np.uint64(64 - bits)
            self._ended = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))
            self._slots = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)
        at = self._slots.take((h >> self._shift).view(np.int64)).astype(np.int64)
        found = self._ended.take(at)
        before = np.flatnonzero(found < h)
        while len(before):
            at[before] += 1
            found[before] = self._ended.take(at.take(before))
            before = before[found.take(before) < h.take(before)]
        known = (found == h) & (at < len(self.keys))
        return np.minimum(at, len(self.keys) - 1), known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's symbol, whether it is known, and its place among the keys."""
        if not len(self.keys):
            return (h & np.uint64(TAILS - 1)).astype(np.uint16), np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at, known = self.place(h)
        symbol = np.where(known, self.symbol.take(at), np.uint16(self.words) + (h & np.uint64(TAILS - 1)).astype(np.uint16))
        return symbol, known, at


def _vocabulary(counts: DataFrame, known: int, n_words: int, width: int) -> tuple[Vocabulary, np.ndarray, np.ndarray, int, int]:
    """The vocabulary, the masses of its words and of the tails, N and V."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    tail = F.col("h").bitwiseAND(TAILS - 1)
    rows = counts.groupBy(step.alias("step"), tail.alias("tail")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()  # some hundred steps
    total, types = sum(r["n"] for r in rows), sum(r["types"] for r in rows)
    least, held = 1, 0
    for s in sorted({r["step"] for r in rows}, reverse=True):
        held += sum(r["types"] for r in rows if r["step"] == s)
        if held > known:
            break
        least = min(r["least"] for r in rows if r["step"] == s)
    else:
        least = 0
    if held > known and least == 1:
        least = total + 1  # one step alone has too many
    got = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    top = np.lexsort((h, -n))[: min(n_words, len(h))]
    top = top[: len(top) // width * width or len(top)]
    symbol = (len(top) + (h & np.uint64(TAILS - 1))).astype(np.uint16)
    symbol[top] = np.arange(len(top))
    tails = np.array([sum(r["n"] + 0.5 * r["types"] for r in rows if r["tail"] == k) + 0.5 for k in range(TAILS)], dtype=np.float64)
    mass = n[top] + 0.5
    np.subtract.at(tails, (h[top] & np.uint64(TAILS - 1)).astype(np.int64), mass)
    return Vocabulary(h, n, symbol, len(top)), mass, tails, int(total), int(types)


def _segments(docs: DataFrame, vocabulary, share: float, segment: int) -> DataFrame:
    """``key, ids``: a share of all segments of ``segment`` tokens, as symbols; which ones depends on the text's hash."""
    long = segment * 32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            for part in chunks(batch.column(0)):
                h, first = tokens(batch.column(0)[part.start : part.stop])
                symbol = vocab.look(h)[0]
                out = []
                for key, whole, s, e in zip(keys[part.start : part.stop], batch.column(2)[part.start : part.stop].to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    parts = np.arange(s, e, segment)
                    names = mix(key + parts.astype(np.uint64) - np.uint64(s) + np.uint64(1))
                    take = np.ones(len(parts), bool) if whole else names < np.uint64(min(share, 1 - 1e-9) * 2.0**64)
                    out += [(int(k), symbol[a : min(a + segment, e)].tobytes()) for k, a in zip(names[take].view(np.int64), parts[take].tolist())]
                if out:
                    k, b = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.binary())], names=["key", "ids"])

    key = F.xxhash64("doc_id", "text")
    cap = F.lit(min((1 << 64) - 1, int(share * 2.0**64)) - (1 << 63))
    short = F.octet_length("text") <= long
    rows = docs.select("text", key.alias("key"), (short | F.lit(share >= 1)).alias("whole")).where(~F.col("whole") | (F.col("key") <= cap))
    return rows.mapInArrow(cut, "key long, ids binary")


def _averaged(trained: DataFrame, fan: int, groups: int) -> np.ndarray | None:
    """The mean of the copies' weights by their tokens; ``slot, part, n, values`` with doubles times ``n``."""

    def add(table: pa.Table) -> pa.Table:
        values = np.sum([np.frombuffer(v) for v in table["values"].to_pylist()], axis=0)
        one = lambda c: pa.array([c], pa.int64())
        return pa.table({"slot": one(table["slot"][0].as_py()), "part": one(table["part"][0].as_py()), "n": one(sum(table["n"].to_pylist())), "values": pa.array([values.tobytes()], pa.binary())})

    while groups > 1:
        trained = trained.withColumn("part", F.expr(f"part div {fan}")).groupBy("slot", "part").applyInArrow(add, "slot long, part long, n long, values binary")
        groups = -(-groups // fan)
    rows = trained.orderBy("slot").toArrow()  # one row a slot
    return np.concatenate([np.frombuffer(v) / n for v, n in zip(rows["values"].to_pylist(), rows["n"].to_pylist())]) if rows.num_rows else None


_SLOT = 1 << 14


def _train(spark, segments: DataFrame, weights: gru.Weights, n_words: int, groups: int, passes: int, repeats: int, fan: int) -> gru.Weights:
    dealt = segments.repartition(groups, F.expr(f"pmod(key, {groups})"))
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(weights)

        def learn(table: pa.Table) -> pa.Table:
            order = np.argsort(table["key"].to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            parts = [np.frombuffer(b, dtype=np.uint16) for b in table["ids"].to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            weights, ids = shared.value, np.concatenate(parts)
            for _ in range(repeats):
                weights = gru.train(weights, ids, first, n_words)
            new = weights.flat().astype(np.float64) * first[-1]
            slots = [new[s : s + _SLOT].tobytes() for s in range(0, len(new), _SLOT)]
            many = lambda v: pa.array([int(v)] * len(slots), pa.int64())
            return pa.table({"slot": pa.array(range(len(slots)), pa.int64()), "part": many(table["part"][0].as_py()), "n": many(first[-1]), "values": pa.array(slots, pa.binary())})

        trained = dealt.withColumn("part", F.expr(f"pmod(key, {groups})")).groupBy("part").applyInArrow(learn, "slot long, part long, n long, values binary")
        mean = _averaged(materialize(trained, "copies"), fan, groups)
        if mean is None:
            break
        weights = weights.like(mean)
    return weights


def score_documents(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4096,
    width: int = 64,
    hidden: int = 16,
    known: int = 1 << 19,
    sample_every: int = 1,
    least_tokens: int = 1_500_000,
    segment: int = 512,
    group_tokens: int = 500_000,
    passes: int = 2,
    fan: int = 64,
    pool_tokens: int = 4_000_000,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows with ``held_out`` are not learned from."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = base.where(~F.col("held_out"))
    counts = materialize(_count(learn, pool_tokens), "counts")
    vocab, mass, tails, total, types = _vocabulary(counts, known, words, width)
    n_words = vocab.words
    weights = gru.start_weights(mass, tails, width, hidden) if total else None
    shared = spark.sparkContext.broadcast(vocab)
    if total:
        share = min(1.0, max(1 / sample_every, least_tokens / total))
        groups = max(1, -(-int(total * share) // group_tokens))
        repeats = min(8, max(1, -(-least_tokens // total)))
        weights = _train(spark, materialize(_segments(learn, shared, share, segment), "segments"), weights, n_words, groups, passes, repeats, fan)
    model = spark.sparkContext.broadcast((weights, np.log10(tails)))
    spread = math.log10(total + 0.5 * (types + 1))
    beyond = types > len(vocab.keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, (weights, log_tails) = shared.value, model.value
        logs = np.log10(vocab.counts + 0.5)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids = np.concatenate([x[1] for x in held])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
            net = gru.score(weights, ids, first, n_words) / _LOG10 if weights is not None else np.zeros(len(first) - 1)
            at = 0
            for rows, _, f, n_known, log_sum, tail_sum, (lists, hashes, times) in held:
                n = rows.num_rows
                log_net = net[at : at + n] + tail_sum if weights is not None else log_sum - np.diff(f) * spread
                at += n
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.diff(f)), pa.array(n_known), pa.array(log_sum), pa.array(log_net), pa.ListArray.from_arrays(lists, hashes), pa.ListArray.from_arrays(lists, times)],
                    names=["doc_id", "held_out", "k1", "k2", "n_tokens", "n_known", "log_sum", "log_net", "others", "times"],
                )
            held.clear()

        for batch in batches:
            rows = batch.select(["doc_id", "held_out", "k1", "k2"])
            for part in chunks(batch.column("text")):
                h, first = tokens(batch.column("text")[part.start : part.stop])
                symbol, is_known, place = vocab.look(h)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                by_doc = lambda v, where=slice(None): np.bincount(doc[where], weights=v[where], minlength=len(part))  # noqa: B023, E731
                log = np.full(len(h), math.log10(0.5))
                log[is_known] = logs.take(place[is_known]) if len(vocab.keys) else 0
                out = ~is_known if beyond else np.zeros(len(h), bool)
                log[out] = 0  # their counts come later
                in_tail = symbol >= n_words
                tail_log = log - log_tails[np.where(in_tail, symbol - n_words, 0)]
                others = _distinct(doc[out], h[out], len(part))
                held.append((rows.slice(part.start, len(part)), symbol, first, by_doc(is_known.astype(float)).astype(np.int64), by_doc(log), by_doc(tail_log, in_tail), others))
                size += len(h)
                if size >= pool_tokens:
                    yield from flush()
                    size = 0
        yield from flush()
        trim()

    keyed = base.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text")).select("doc_id", "held_out", "k1", "k2", "text")
    scored = keyed.mapInArrow(score, "doc_id long, held_out boolean, k1 long, k2 long, n_tokens long, n_known long, log_sum double, log_net double, others array<long>, times array<int>")
    result = lambda df, log_sum, log_net, n_known: df.select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (log_sum - F.col("n_tokens") * F.lit(spread)).alias("base_score"), log_net.alias("score"),
    )
    if not beyond:
        return result(scored, F.col("log_sum"), F.col("log_net"), F.col("n_known"))
    scored = materialize(scored, "scored")
    pairs = scored.where("size(others) > 0").select("k1", "k2", F.explode(F.arrays_zip("others", "times")).alias("o")).groupBy("k1", "k2", F.col("o.others").alias("h")).agg(F.max("o.times").alias("times"))
    found = pairs.join(counts, "h", "left").groupBy("k1", "k2").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    full = scored.drop("others", "times").join(found, ["k1", "k2"], "left")
    more = F.coalesce("more", F.lit(0.0))
    return result(full, F.col("log_sum") + more, F.col("log_net") + more, (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long"))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Each document's different hashes and how often it holds them, as list offsets and values."""
    if not len(h):
        return pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()), pa.array([], pa.int32())
    order, at = runs(mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    one, times = order[at], np.diff(np.append(at, len(order)))
    back = np.argsort(doc[one], kind="stable")
    one, times = one[back], times[back]
    return pa.array(np.searchsorted(doc[one], np.arange(n + 1)).astype(np.int32)), pa.array(h[one].view(np.int64)), pa.array(times.astype(np.int32))
