"""Dataset curation: deduplication, conflicts, balance, splits, samples and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.ordered import by_hash, row_numbers


def draw(*cols: str) -> Column:
    """A reproducible order: the md5 of the key (other engines agree on it)."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def dedup_exact(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text, compared in lower case and trimmed.

    The survivor is found by an aggregation with a map-side combine, so copies never meet in one window.
    """
    key = F.sha2(F.lower(F.trim(text)), 256)
    rows = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.groupBy(key.alias("_k")).agg(F.min_by(rows, F.struct(*order)).alias("r")).select("r.*").select(*df.columns)


def dedup_sessions(df: DataFrame) -> DataFrame:
    """The first session of each sequence of actions, whole."""
    seq = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"]), "\x1f"), 256)
    keys = df.groupBy("session_id").agg(seq.alias("seq"))
    first = keys.groupBy("seq").agg(F.min("session_id").alias("session_id"))
    return df.join(first, "session_id", "left_semi")


def cross_dataset_overlap(df: DataFrame, text: str, source: str) -> DataFrame:
    """Per pair of sources how many texts they share, and the share of the smaller side."""
    key = df.select(F.col(source).alias("s"), F.md5(text).alias("h")).distinct()
    sizes = key.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    pairs = key.alias("a").join(key.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.s") < F.col("b.s"))).groupBy(F.col("a.s").alias("left"), F.col("b.s").alias("right")).agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(F.broadcast(sizes.toDF("left", "n_left")), "left").join(F.broadcast(sizes.toDF("right", "n_right")), "right")
    return out.select("left", "right", "shared", F.round(F.col("shared") / F.least("n_left", "n_right"), 8).alias("overlap"))


def drop_cross_dataset(df: DataFrame, text: str, source: str, share: float = 0.2) -> DataFrame:
    """Without the texts (lower case, trimmed) that a source has in common with another, where that is over ``share`` of either one.

    They go from the smaller source, of equal ones from the second by name; what earlier pairs removed still counts.
    """
    rows = df.withColumn("_h", F.md5(F.lower(F.trim(text))))
    key = rows.select(F.col(source).alias("s"), F.col("_h").alias("h")).distinct()
    sizes = key.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    shared = key.alias("a").join(key.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.s") < F.col("b.s"))).select(F.col("a.s").alias("l"), F.col("b.s").alias("r"), F.col("a.h").alias("h"))
    pairs = shared.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sizes.toDF("l", "nl")), "l").join(F.broadcast(sizes.toDF("r", "nr")), "r")
    pairs = pairs.where(F.col("n") > share * F.least("nl", "nr")).select("l", "r", F.when(F.col("nl") < F.col("nr"), F.col("l")).otherwise(F.col("r")).alias("_s"))
    gone = shared.join(F.broadcast(pairs), ["l", "r"]).select("_s", F.col("h").alias("_g")).distinct()  # a row per pair of sources is broadcast
    return rows.join(gone, (F.col(source) == F.col("_s")) & (F.col("_h") == F.col("_g")), "left_anti").drop("_h")


def resolve_conflicts(df: DataFrame, text: str, label: str, priority: str) -> DataFrame:
    """Per text the label of the highest priority; texts whose top priority disagrees go."""
    top = df.groupBy(text).agg(F.max(priority).alias("_p"))
    best = df.join(top, text).where(F.col(priority) == F.col("_p"))
    return best.groupBy(text).agg(F.min(label).alias(label), F.max(label).alias("_m")).where(F.col(label) == F.col("_m")).drop("_m")


def rank_within(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Numbers the rows of each group in the drawn order, however large the group is."""
    drawn = df.withColumn("_draw", draw(*key))
    return row_numbers(by_hash(drawn, F.col("_draw")), by, [F.col("_draw"), *[F.col(k) for k in key]], "rn").drop("_draw")


def sample_per_group(df: DataFrame, by: list[str], key: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each group; Spark limits each partition before the shuffle."""
    order = Window.partitionBy(*by).orderBy(draw(*key), *key)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def sample_n(df: DataFrame, key: list[str], n: int) -> DataFrame:
    return df.orderBy(draw(*key), *key).limit(n)


def balance(df: DataFrame, label: str, key: list[str], majority_share: float = 0.6, dead_band: float = 0.05) -> DataFrame:
    """Down-samples the larger label to ``majority_share``, unless it is within the dead band."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row per label
    if len(counts) != 2:
        return df
    (small, few), (large, many) = sorted(counts.items(), key=lambda x: (x[1], str(x[0])))
    if many / (few + many) <= majority_share + dead_band:
        return df
    keep = int(few * majority_share / (1 - majority_share))
    return df.where(F.col(label) == small).unionByName(sample_n(df.where(F.col(label) == large), key, keep))


def stratified_sample(df: DataFrame, by: str, key: list[str], total: int) -> DataFrame:
    """A proportional share of each group, one row at least."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).select(by, F.greatest(F.lit(1), F.floor(total * F.col("_n") / F.col("_all"))).alias("_k"))
    return rank_within(df, [by], key).join(F.broadcast(shares), by).where(F.col("rn") <= F.col("_k")).drop("rn", "_k")


def kfold(df: DataFrame, label: str, key: list[str], k: int = 5) -> DataFrame:
    """Stratified folds: the rows of a label are dealt in the drawn order."""
    return rank_within(df, [label], key).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k))).drop("rn")


def group_split(df: DataFrame, group: str, train_percent: int = 85) -> DataFrame:
    """Train or eval by the hash of the group, so that a group is never on both sides."""
    return df.withColumn("split", F.when(F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100)) < train_percent, "train").otherwise("eval"))


def validate(df: DataFrame) -> DataFrame:
    """One row of problem counts: nulls, values outside their domain, sessions with gaps."""
    bad = df.agg(
        F.count_if(F.col("action").isNull()).alias("null_action"),
        F.count_if(F.col("session_id").isNull()).alias("null_session"),
        F.count_if(~F.coalesce(F.col("label").isin("malicious", "benign"), F.lit(False))).alias("bad_label"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    gaps = df.groupBy("session_id").agg((F.max("step") - F.min("step") + 1 - F.countDistinct("step")).alias("g")).agg(F.count_if(F.col("g") > 0).alias("gap_sessions"))
    return bad.crossJoin(F.broadcast(gaps))


def whole_sessions(df: DataFrame, which: Column) -> DataFrame:
    """All rows of the sessions of which a row meets ``which``: sessions are kept whole, whatever that does to the balance."""
    return df.join(df.where(which).select("session_id").distinct(), "session_id", "left_semi")


def containment(df: DataFrame, held_out: DataFrame, key: str, text: str, other: str, words: int = 8) -> DataFrame:
    """``key, shared, grams``: of the distinct word n-grams of each text how many a held-out table has, too, and how many there are.

    ``words`` is a power of two: hashes of n-grams are made of those of half their length. Only hashes meet; texts that share none are
    not in the result.
    """
    if words & (words - 1):
        raise ValueError("words must be a power of two")

    def doubled(half: str, n: int) -> Column:
        size = F.size(half) - n
        starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(half, i), F.get(half, i + n)))

    def grams(d: DataFrame, column: str) -> DataFrame:
        w = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
        d = d.withColumn("_g1", F.transform(w, lambda x: F.xxhash64(x)))
        n = 1
        while n < words:
            d = d.withColumn(f"_g{2 * n}", doubled(f"_g{n}", n))
            n *= 2
        return d.withColumn("_g", F.array_distinct(f"_g{words}"))

    # outer, as a plain explode would have the optimiser test the array, with all that makes it, once more below
    known = grams(held_out, other).select(F.explode_outer("_g").alias("_k")).where("_k IS NOT NULL").distinct()
    mine = grams(df, text).select(key, F.size("_g").alias("grams"), F.explode_outer("_g").alias("_h")).where("_h IS NOT NULL")
    return mine.join(known, F.col("_h") == F.col("_k")).groupBy(key, "grams").agg(F.count(F.lit(1)).alias("shared")).select(key, "shared", F.col("grams").cast("bigint").alias("grams"))
