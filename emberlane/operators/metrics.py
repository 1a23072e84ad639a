"""Detection metrics, calibration sweeps and signal voting as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.ordered import by_quantile, running

Z95 = 1.959964


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two digits, 0 if there is no whole."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)), 2)


def confusion_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates per group from ``truth`` (0/1), ``blocked`` and ``attack_kind`` in one pass."""
    bad, hit = F.col("truth") == 1, F.col("blocked")
    multi = F.col("attack_kind") == "multi"
    n = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(
        n(bad & hit).alias("tp"), n(~bad & hit).alias("fp"), n(~bad & ~hit).alias("tn"), n(bad & ~hit).alias("fn"),
        n(bad & hit & ~multi).alias("tp_single"), n(bad & ~multi).alias("n_single"), n(bad & hit & multi).alias("tp_multi"), n(bad & multi).alias("n_multi"),
    )
    return out.select(
        *by, "tp", "fp", "tn", "fn",
        percent(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("absr"),
        percent(F.col("tp_single"), F.col("n_single")).alias("absr_single"), percent(F.col("tp_multi"), F.col("n_multi")).alias("absr_multi"),
    )


def session_block_rate(df: DataFrame, first_step_only: bool) -> DataFrame:
    """Percentage of sessions of which any (or the first) step is blocked."""
    hit = F.min_by("blocked", F.struct("step", "doc_id")) if first_step_only else F.bool_or("blocked")
    return df.groupBy("session_id").agg(hit.alias("hit")).agg(F.count(F.lit(1)).alias("sessions"), percent(F.count_if("hit"), F.count(F.lit(1))).alias("rate"))


def steady_state_fpr(df: DataFrame, warm_up: int = 30) -> DataFrame:
    """False positive rate after the first ``warm_up`` sessions in order of appearance.

    Sessions are ranked, not rows: the ranking runs over one row per session.
    """
    first = df.groupBy("session_id").agg(F.min("doc_id").alias("first"))
    late = first.orderBy("first").limit(warm_up).select("session_id")
    rest = df.join(F.broadcast(late), "session_id", "left_anti")
    clean = F.col("truth") == 0
    return rest.agg(F.count_if(clean).alias("benign"), percent(F.count_if(clean & F.col("blocked")), F.count_if(clean)).alias("steady_fpr"))


def latency_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, deviation and percentiles as the element at ``floor(p * (n - 1))`` of the sorted values.

    Equal values are counted before anything is ordered, so windows see distinct values with their counts.
    """
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(by_quantile(counts.where("_x IS NOT NULL"), "_x"), by, [F.col("_x")], {"_upto": F.col("_n")})
    size = df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"), F.count(value).alias("_all"))
    on = [ranked[c].eqNullSafe(size[c]) for c in by]
    joined = size.join(ranked, on, "left").select(*[size[c] for c in by], "mean", "stdev", "_all", "_x", "_upto")
    at = lambda p, n: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("_x"))).alias(n)
    return joined.groupBy(*by, "mean", "stdev").agg(at(0.5, "p50"), at(0.9, "p90"), at(0.99, "p99"))


def proportion_ci(df: DataFrame, flag: str, by: list[str]) -> DataFrame:
    """Mean of a flag with its normal 95 % interval, clipped to 0 .. 1."""
    out = df.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias("mean"), F.count(F.lit(1)).alias("n"))
    half = Z95 * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    return out.select(*by, "n", F.round("mean", 8).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("mean") - half), 8).alias("low"), F.round(F.least(F.lit(1.0), F.col("mean") + half), 8).alias("high"))


def wilson_ci(df: DataFrame, flag: str, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    z2 = Z95 * Z95
    mid = (F.col("p") + z2 / (2 * F.col("n"))) / (1 + z2 / F.col("n"))
    half = Z95 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z2 / (4 * F.col("n") * F.col("n"))) / (1 + z2 / F.col("n"))
    return out.select(*by, "n", F.round(mid - half, 8).alias("low"), F.round(mid + half, 8).alias("high"))


def score_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score (within a group), how many rows of either truth score at least that much.

    Rows are summed by score before the running sums, which are taken bucket by bucket.
    """
    by = by or []
    by_score = df.groupBy(*by, "score").agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n"))
    up = running(by_quantile(by_score, "score", descending=True), by, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    whole = by_score.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    joined = up.join(whole, [up[c].eqNullSafe(whole[c]) for c in by]) if by else up.crossJoin(F.broadcast(whole))  # one row
    return joined.select(*[up[c] for c in by], "score", "tp", "fp", "pos", "neg")


def threshold_sweep(df: DataFrame, fpr_budget: float = 0.05, fnr_budget: float = 0.05) -> DataFrame:
    """Block threshold: least misses within the false positive budget; review: highest with few misses.

    If review is not below block, it falls to block less 0.20, at least 0.20.
    """
    rates = score_counts(df).select("score", (F.col("fp") / F.col("neg")).alias("fpr"), ((F.col("pos") - F.col("tp")) / F.col("pos")).alias("fnr"))
    out = rates.agg(F.min_by("score", F.when(F.col("fpr") <= fpr_budget, F.struct("fnr", -F.col("score")))).alias("block"), F.max(F.when(F.col("fnr") <= fnr_budget, F.col("score"))).alias("review"))
    return out.select("block", F.when(F.col("review") < F.col("block"), F.col("review")).otherwise(F.greatest(F.lit(0.2), F.round(F.col("block") - 0.2, 10))).alias("review"))


def calibrate_thresholds(df: DataFrame, by: str, key: str, fpr_budget: float = 0.01, fnr_budget: float = 0.05, least: int = 10) -> DataFrame:
    """``by, block, review`` from about seven tenths of each group's labelled rows, chosen by a hash of the key.

    Block is the score with the fewest misses within the false positive budget (of equals the lowest; 1.0 if none is), review the
    highest with few misses (else 0.35); the larger of the two blocks, the smaller reviews, from 0.20 on. Groups with under
    ``least`` rows of either truth have no row.
    """
    enough = df.groupBy(by).agg(F.count_if(F.col("truth") == 0).alias("_b"), F.count_if(F.col("truth") == 1).alias("_m")).where((F.col("_b") >= least) & (F.col("_m") >= least)).select(F.col(by).alias("_by"))
    part = df.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(10)) < 7)
    rates = score_counts(part, [by]).withColumn("fpr", F.col("fp") / F.greatest("neg", F.lit(1))).withColumn("fnr", (F.col("pos") - F.col("tp")) / F.greatest("pos", F.lit(1)))
    out = rates.groupBy(by).agg(
        F.coalesce(F.min_by("score", F.when((F.col("fpr") <= fpr_budget) & (F.col("fnr") < 1), F.struct("fnr", "score"))), F.lit(1.0)).alias("a"),
        F.coalesce(F.max(F.when(F.col("fnr") <= fnr_budget, F.col("score"))), F.lit(0.35)).alias("b"),
    )
    out = out.join(enough, F.col(by) == F.col("_by"), "left_semi")
    return out.select(by, F.round(F.greatest("a", "b"), 4).alias("block"), F.round(F.greatest(F.lit(0.2), F.least("a", "b")), 4).alias("review"))


def f1_sweep(df: DataFrame) -> DataFrame:
    counts = score_counts(df).withColumn("f1", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")))
    return counts.agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.round(F.max("f1"), 10).alias("f1"))


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no row of greater or equal ``x`` beats in ``y``: running maxima from the right, bucket by bucket."""
    cut = by_quantile(df, x, descending=True)
    tops = cut.groupBy("_b").agg(F.max(y).alias("_top"))
    before = tops.select(F.col("_b").alias("_k"), F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))  # a row per bucket
    inside = Window.partitionBy("_b").orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(before), F.col("_b") == F.col("_k")).withColumn("_best", F.greatest(F.max(y).over(inside), F.col("_above")))
    return out.where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).select(*df.columns)


def family_vote(signals: DataFrame) -> DataFrame:
    """Score and tier per action.

    Score: the strongest critical signal and a tenth of the others' sum, else the mean of the families' maxima above
    zero, a fifth of it if the judge is sure of a harmless action. Tier: critical signals of two families, or of one
    with support from the others, quarantine; else score and highest severity decide.
    """
    w = F.col("severity") * F.col("confidence")
    crit = F.col("is_critical")
    out = signals.groupBy("action_id").agg(
        F.max(F.when(crit, w)).alias("top"),
        F.coalesce(F.sum(F.when(~crit, w)), F.lit(0.0)).alias("others"),
        F.max(F.when(F.col("family") == "structural", w)).alias("a"),
        F.max(F.when(F.col("family") != "structural", w)).alias("b"),
        F.bool_or((F.col("name") == "v61_llm_judge") & (F.col("severity") <= 20) & (F.col("confidence") >= 0.8)).alias("harmless"),
        F.countDistinct(F.when(crit, F.col("family"))).alias("sources"),
        F.max("severity").alias("worst"),
    )
    some = F.filter(F.array("a", "b"), lambda v: v > 0)
    mean = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda acc, v: acc + v) / F.size(some)).otherwise(F.lit(0.0))
    score = F.when(F.col("top").isNotNull(), F.col("top") + 0.1 * F.col("others")).otherwise(mean * F.when(F.col("harmless"), 0.2).otherwise(1.0))
    out = out.withColumn("score", F.round(F.least(F.lit(100.0), score), 6))
    sure = (F.col("sources") >= 2) | ((F.col("sources") == 1) & (F.col("others") >= 20)) | (F.col("score") >= 90)
    tier = (
        F.when(sure, "QUARANTINE").when((F.col("score") >= 82) & (F.col("worst") > 85), "DENY")
        .when((F.col("score") >= 68) | (F.col("worst") > 75), "REVIEW").when(F.col("score") >= 40, "MONITOR").otherwise("ALLOW")
    )
    return out.select("action_id", "score", tier.alias("tier"))


def weighted_vote(signals: DataFrame) -> DataFrame:
    """The older vote: mean severity weighted by confidence; a sure critical signal decides alone."""
    out = signals.groupBy("action_id").agg(F.sum(F.col("severity") * F.col("confidence")).alias("num"), F.sum("confidence").alias("den"), F.bool_or(F.col("is_critical") & (F.col("confidence") >= 0.9)).alias("gate"))
    score = F.when(F.col("gate"), F.lit(100.0)).when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    return out.select("action_id", F.round(score, 6).alias("score"), "gate")
