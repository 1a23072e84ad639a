"""Language identification by a blended-spectrum string kernel.

Method. A text's features are the byte n-grams (1 to 3 bytes, ASCII letters lower-cased) that occur in it,
present or not. The kernel of two texts is the number of n-grams they share, normalised by the
geometric mean of their own numbers. ``landmarks`` texts per language span a Nyström map
``K(x, L) K(L, L)^(-1/2)``, and one ridge regression per language (one-versus-rest, targets +1 and -1)
is solved on it. Landmarks, map and weights are linear in the presences, so they are multiplied out once, to
one weight per n-gram and language; scoring is one matrix product per batch, presences times that matrix.

Fit. ``per_lang`` texts of at most ``max_bytes`` bytes are expected per language (documented bound; the rows
with the smallest hashes), whatever the table's size; at most twice that many are taken. Languages are
counted by the texts that may be taken; one that has longer texts alone is learned from those, each cut to
``max_bytes`` for the fit. n-grams are those of the fitting texts. Every text is scored whole.

Size. The driver holds the sample; the workers get ``n-grams x languages`` numbers, which must not exceed
``max_model_bytes`` (an error says so), and hold a bounded number of presences at a time.

Edge cases. A text without a letter, or null, is ``und`` with score 0. Null languages and ids are no part
of the fit; rows with them are predicted. Ties go to the language that sorts first. Repeated rows each get a
row, and count once in the fit. An empty table gives no rows; if no row can be learned from, all is ``und``.
Very long texts are scored whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm.packing import chunks
from emberlane.llm.wordhash import buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = [9, 10, 11, 12, 13]
_LOWER[_SPACE] = 32


def _codes(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-gram codes (below 2**24 + 2**16 + 2**8) for n = 1, 2, 3 and where they lie; none crosses texts."""
    one = _LOWER[data].astype(np.int32)
    two = (one[:-1] << 8) | one[1:]
    three = (two[:-1] << 8) | one[2:]
    out = []
    for n, code in ((1, one), (2, two + (1 << 8)), (3, three + ((1 << 16) + (1 << 8)))):
        ok = np.ones(len(code), dtype=bool)
        for k in range(1, n):
            cut = at[1:-1] - k
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        out.append((code, ok))
    return out


_SIZE = (1 << 24) + (1 << 16) + (1 << 8)
_CELLS = 1 << 24


def presence(texts: pa.Array, column: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix: which of the ``width`` known n-grams each text holds (column 0 gathers the unknown)."""
    data, at = buffers(texts)
    out = np.zeros((len(texts), width), dtype=np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * width, np.diff(at))
    flat = out.ravel()
    for code, ok in _codes(data, at):
        where = row[: len(code)] + column[code]
        flat[where[ok]] = 1
    out[:, 0] = 0
    return out


@dataclass
class Model:
    """What the workers need to score: the n-grams and their weights, one row each after that of the unknown."""

    langs: list[str]
    grams: np.ndarray
    weights: np.ndarray

    @property
    def rows(self) -> int:
        """Texts scored at a time."""
        return max(8, _CELLS // (len(self.grams) + 1))

    def column(self) -> np.ndarray:
        table = np.zeros(_SIZE, dtype=np.int32)
        table[self.grams] = np.arange(1, len(self.grams) + 1)
        return table

    def score(self, texts: pa.Array, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = presence(texts, column, len(self.grams) + 1)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        f = (x @ self.weights) / norm
        best = f.argmax(axis=1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)


def fit(texts: list[str], langs: list[str], landmarks: int, ridge: float) -> Model | None:
    """Ridge regressions on a Nyström map; ``texts`` come in a fixed order, the landmarks lead each language."""
    names = sorted(set(langs))
    if not names:
        return None
    data, at = buffers(pa.array(texts, pa.string()))
    seen = [np.unique(code[ok]) for code, ok in _codes(data, at)] if len(data) else []
    grams = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int32)
    model = Model(names, grams, np.zeros((len(grams) + 1, len(names)), np.float32))
    column = model.column()
    y = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    marks = presence(pa.array([texts[i] for i in chosen], pa.string()), column, len(grams) + 1)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    rows = []
    for s in range(0, len(texts), model.rows):
        x = presence(pa.array(texts[s : s + model.rows], pa.string()), column, len(grams) + 1)
        rows.append((x @ marks.T) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)))
    k = np.concatenate(rows).astype(np.float64)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # classes weigh the same, however many texts they have
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    a = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    model.weights = (marks.T.astype(np.float64) @ (root @ np.linalg.solve(a, (phi * weight[:, None]).T @ target))).astype(np.float32)
    return model


def _training(docs: DataFrame, learn: Column, per_lang: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """A bounded sample for the fit, by the hash of id and text."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    fits = F.octet_length("text") <= max_bytes
    counted = rows.groupBy("lang").agg(F.count_if(fits).alias("short"), F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counted:
        return [], []
    order = F.xxhash64("doc_id", "text")
    cut = None
    for r in counted:
        n, ok = (r["short"], fits) if r["short"] else (r["n"], F.lit(True))
        top = min((1 << 64) - 1, (1 << 64) * per_lang // n) - (1 << 63)
        cut = F.when(F.col("lang") == r["lang"], ok & (order <= F.lit(top))) if cut is None else cut.when(F.col("lang") == r["lang"], ok & (order <= F.lit(top)))
    once = rows.where(cut).groupBy("lang", order.alias("o")).agg(F.min(F.left("text", F.lit(max_bytes))).alias("text"))
    got = once.orderBy("o", "lang").limit(2 * per_lang * len(counted)).collect()
    got.sort(key=lambda r: (r["lang"], r["o"]))
    taken: dict[str, int] = {}
    out = []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= 2 * per_lang:
            out.append(r)
    return [r["text"] for r in out], [r["lang"] for r in out]


def identify_languages(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 400,
    landmarks: int = 48,
    max_bytes: int = 20_000,
    ridge: float = 1e-4,
    max_model_bytes: int = 256 << 20,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; rows with ``held_out`` are no part of the fit."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(*_training(base, ~F.col("held_out"), per_lang, max_bytes), landmarks, ridge)
    if model and model.weights.nbytes > max_model_bytes:
        raise ValueError(f"{len(model.langs)} languages and {len(model.grams)} n-grams exceed max_model_bytes")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        column = model.column() if model else None
        for batch in batches:
            lang = np.array(["und"] * len(batch), dtype=object)
            score = np.zeros(len(batch))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for part in chunks(batch.column(3)) if model else ():
                for s in range(part.start, part.stop, model.rows):
                    e = min(s + model.rows, part.stop)
                    best, value = model.score(batch.column(3)[s:e], column)
                    lang[s:e] = np.array(model.langs, dtype=object)[best]
                    score[s:e] = value
            lang[~letters] = "und"
            score[~letters] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.select("doc_id", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
