"""Quality rules: fixed text rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Method. Words and word pairs of a text are hashed into ``buckets`` cells. Two multinomials over the
cells are counted, one over every document (raw corpus) and one over the documents that a label marks
as trusted (target). A document's score is the mean over its n-grams of
``log(p_target / p_raw)``. A mean hides a few insults among hundreds of neutral words, so words typical of
texts labelled toxic are found as well (:func:`toxic_words`). A document is kept if no fixed rule fails, the
score reaches ``threshold`` and it has fewer than ``max_toxic_words`` of those. Nothing is random, so every document gets the same verdict in every run.

Edge cases. Null text counts as empty: no word, score 0, ``base_failed``. A null document id is never
trusted but is scored. Texts of any length are read whole. Repeated rows each get a row. An empty table gives no rows. Without any trusted
document nothing is expected in the target, all ratios are zero, and the fixed rules decide; without any
that is labelled toxic, or with too few to tell, no word counts as toxic. Other columns,
whatever their names, are carried in a struct and never clash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm.scratch import materialize, side_of, where_once

SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
_POSITION = (1 << 24) - 1


def _upto(n: Column) -> Column:
    """0 .. n-1, nothing for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_ngrams(df: DataFrame, text: str) -> DataFrame:
    """Add ``_words`` and the hashes of words (``_w1``) and of word pairs (``_w2``)."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_bare", F.btrim("_t", F.lit(SPACES)))
    df = df.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", WORD_GAP)))
    df = df.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_words"))
    return df.withColumn("_w2", F.transform(_upto(F.col("_n") - 1), lambda i: F.xxhash64(F.get("_w1", i), F.get("_w1", i + 1))))


def with_base_signals(df: DataFrame) -> DataFrame:
    """Add the fixed rules' signals to a frame that has passed :func:`with_ngrams`."""
    df = df.withColumn("_w4", F.transform(_upto(F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w2", i), F.get("_w2", i + 2))))
    df = df.withColumn("_w8", F.transform(_upto(F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.get("_w4", i), F.get("_w4", i + 4))))
    # Only texts with a repeated window pay for a sort. It is one of longs, which hold the head of a hash and a position; where
    # positions need more bits, or hashes with equal heads differ, whole hashes are sorted with their positions beside them.
    df = df.withColumn("_dup", F.size(F.array_distinct("_w8")) < F.size("_w8"))
    head = lambda x: x.bitwiseAND(F.lit(~_POSITION))
    packed = F.sort_array(F.transform("_w8", lambda h, i: head(h).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("_packed", F.when(F.col("_dup") & (F.size("_w8") <= _POSITION), packed).otherwise(F.array().cast("array<bigint>")))
    hash_of = lambda x: F.get("_w8", x.bitwiseAND(F.lit(_POSITION)).cast("int"))
    beside = lambda j: F.get("_packed", j)
    mixed = F.filter("_packed", lambda x, j: (j > 0) & (head(x) == head(beside(j - 1))) & (hash_of(x) != hash_of(beside(j - 1))))
    df = df.withColumn("_whole", F.col("_dup") & ((F.size("_w8") > _POSITION) | (F.size(mixed) > 0)))
    df = df.withColumn("_sorted", F.when(F.col("_whole"), F.array_sort(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    hash_at = lambda j: F.get("_sorted", j)["h"]
    whole = F.filter("_sorted", lambda x, j: ((j > 0) & x["h"].eqNullSafe(hash_at(j - 1))) | x["h"].eqNullSafe(hash_at(j + 1)))
    short = F.filter("_packed", lambda x, j: ((j > 0) & hash_of(x).eqNullSafe(hash_of(beside(j - 1)))) | hash_of(x).eqNullSafe(hash_of(beside(j + 1))))
    at = F.when(F.col("_whole"), F.transform(whole, lambda x: x["i"].cast("bigint"))).otherwise(F.transform(short, lambda x: x.bitwiseAND(F.lit(_POSITION))))
    df = df.withColumn("_at", F.sort_array(at))
    covered = F.aggregate(
        _upto(F.size("_at")),
        F.lit(0).cast("bigint"),
        lambda acc, k: acc + F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get("_at", k) - F.get("_at", k - 1))).cast("bigint"),
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return df.select(
        "*",
        F.col("_n").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``_target``: labelled of good quality and not toxic by every label it has."""
    good = (
        labels.select(F.col(id_col).alias("_lid"), "quality", "toxic")
        .where(F.col("_lid").isNotNull())
        .groupBy("_lid")
        .agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("_target"))
        .where(F.col("_target") == 1)
    )
    good = side_of(materialize(good, "good"))
    return docs.join(good, F.col("_id") == F.col("_lid"), "left").drop("_lid")


def fit_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, prior: float = 20.0) -> list[float]:
    """Log ratios of the target and raw multinomials, one per bucket, counted over all rows.

    ``prior`` is added to the count of a cell in the target and to the one that the raw corpus lets expect
    there, so a cell says little until it has been seen often; in a small corpus new words count for nothing.
    """
    slim = _trusted(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), labels, id_col)
    cells = F.concat(F.transform("_w1", lambda h: F.pmod(h, F.lit(buckets))), F.transform("_w2", lambda h: F.pmod(h, F.lit(buckets))))
    counts = (
        with_ngrams(slim, "_text")
        .select("_target", F.explode(cells).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_target").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for cell, n, m in counts.collect():  # one row a bucket at most
        raw[cell], target[cell] = n, m
    share = sum(target) / max(1, sum(raw))
    return [math.log((t + prior) / (r * share + prior)) for t, r in zip(target, raw)]


def _plain_words(text: str) -> Column:
    """Hashes of the distinct lower-cased words, without punctuation."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def toxic_words(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.02, lift: float = 8.0) -> list[int]:
    """Hashes of the words that are typical of documents labelled toxic.

    Such a word is in at least ``share`` of them, ``lift`` times as often as in trusted documents, and so
    often that less than one word of their whole vocabulary would be expected to by chance (Chernoff's
    bound). All are shares of documents, so a larger table only adds certainty. ``share`` bounds the list.
    """
    toxic, good = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    kind = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(toxic.cast("int")).alias("_toxic"), F.min(good.cast("int")).alias("_good"))
    kind = kind.where("_toxic + _good = 1")
    kind = side_of(materialize(kind, "kinds"))
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(kind, F.col("_id") == F.col("_lid"))
    counted = slim.select("_toxic", "_good", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), _plain_words("_text"))).alias("word"))
    counted = materialize(counted.groupBy("word").agg(F.sum("_toxic").alias("bad"), F.sum("_good").alias("good")).where("bad > 0"), "toxic")
    total = counted.where("word is null").first()  # each document has one null: the numbers of documents
    if total is None or not total["good"]:
        return []
    n_bad, n_good, vocabulary = total["bad"], total["good"], counted.count()
    p, out = n_bad / (n_bad + n_good), []
    likely = (F.col("bad") >= share * n_bad) & (F.col("bad") / n_bad >= lift * F.col("good") / n_good)
    for word, bad, other in counted.where(F.col("word").isNotNull() & likely).collect():
        n, q = bad + other, bad / (bad + other)
        gain = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if other else 0.0)
        if n * gain >= math.log(vocabulary):
            out.append(word)
    return sorted(out)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 16,
    prior: float = 20.0,
    threshold: float = -0.1,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_toxic_words: int = 2,
) -> DataFrame:
    """One row per input row: ``row`` (a struct of its columns), the signals, ``score`` and ``kept``."""
    toxic = F.from_json(F.lit(json.dumps(toxic_words(docs, labels, id_col=id_col, text_col=text_col))), "array<bigint>")
    weights = fit_weights(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, prior=prior)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded to one literal, bounded by buckets
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    df = with_base_signals(with_ngrams(df, "_text"))

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))

    grams = F.size("_w1") + F.size("_w2")
    df = df.withColumn("score", F.when(grams > 0, (total("_w1") + total("_w2")) / grams).otherwise(F.lit(0.0)))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    df = df.withColumn("n_toxic_words", F.size(F.array_intersect(_plain_words("_t"), toxic)).cast("bigint"))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("n_toxic_words") < max_toxic_words))
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "n_toxic_words", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with their own columns."""
    return where_once(score_quality(docs, labels, **options).select("row", "kept"), F.col("kept")).select("row.*")
