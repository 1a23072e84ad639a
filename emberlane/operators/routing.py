"""Routing of scored actions: thresholds, forced reviews, the judge's answers and what happens without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------
BLOCK_AT, REVIEW_AT, REVIEW_FLOOR, MONITOR_SHARE = 0.72, 0.35, 0.10, 0.20
GRAY_MARGIN, RISK_RATIO = 8.0, 0.75
SEQUENCE_BLOCK, CALM_SEQUENCE, CALM_RISK = 0.65, 0.05, 0.2
# ----------------------------------------------------------------------------------------------------


def judge_parse(response: Column, canary: Column, mode: str = "STRICT") -> Column:
    """``struct<decision, reason>`` of a judge's answer; null (no answer in time) decides by the mode.

    An answer without the canary has been tampered with, one without a verdict line is no answer; both block.
    """
    verdict = F.regexp_extract(response, r"(?m)^VERDICT:\s*(BLOCK|ALLOW)\s*$", 1)
    reason = F.trim(F.regexp_extract(response, r"(?m)^REASON:\s*(.+)$", 1))
    down = "ALLOW" if mode.upper() == "PERMISSIVE" else "BLOCK"
    clean, formed = F.contains(response, canary), verdict != ""
    return F.struct(
        F.when(response.isNull(), down).when(~clean | ~formed, "BLOCK").otherwise(verdict).alias("decision"),
        F.when(response.isNull(), "[LLM_DOWN]").when(~clean, "[INJECTION_DETECTED]").when(~formed, "[FORMAT_VIOLATION]").when(reason == "", "No explanation provided.").otherwise(reason).alias("reason"),
    )


def route(df: DataFrame, score: Column, *, tier: Column, tier_risk: Column, force: Column, camouflaged: Column, judged: Column, block_at: Column | None = None) -> DataFrame:
    """Adds ``decision, path, reason``.

    A block of the tier before stands. Else the score decides; a monitoring tier lowers the review threshold with its risk. What would
    be allowed is reviewed if that is forced or the text is camouflaged. Reviews get the judge's decision (``judged`` is a struct
    of :func:`judge_parse`).
    """
    block = block_at if block_at is not None else F.lit(BLOCK_AT)
    review = F.when(tier == "MONITOR", F.greatest(REVIEW_AT - tier_risk * MONITOR_SHARE, F.lit(REVIEW_FLOOR))).otherwise(F.lit(REVIEW_AT))
    df = df.withColumn("_first", F.when(tier.isin("BLOCK", "QUARANTINE"), "QUARANTINE").when(score >= block, "BLOCK").when(score >= review, "REVIEW").otherwise("ALLOW"))
    why = F.when(F.col("_first") == "ALLOW", F.when(camouflaged, "SEMANTIC_ESCALATED").when(force, "FORCED_BY_CONSEQUENCE_GATE"))
    df = df.withColumn("_why", why).withColumn("_slow", (F.col("_first") == "REVIEW") | F.col("_why").isNotNull())
    path = F.when(F.col("_first") == "QUARANTINE", "Tier0.5").when(F.col("_slow"), "slow-path-llm").otherwise("fast-path-ml")
    decision = F.when(F.col("_slow"), judged["decision"]).otherwise(F.col("_first"))
    return df.withColumn("decision", decision).withColumn("path", path).withColumn("reason", F.coalesce("_why", F.lit(""))).drop("_first", "_why", "_slow")


def gray_zone(tier: Column, score: Column, threshold: Column, cumulative: Column, quarantine_at: Column) -> Column:
    """Whether a decision needs the slow path: a review, a score near the threshold (0 to 100), or much gathered risk."""
    ratio = F.when(quarantine_at > 0, cumulative / quarantine_at).otherwise(F.lit(0.0))
    return (tier == "REVIEW") | (F.abs(score - threshold) <= GRAY_MARGIN) | (ratio >= RISK_RATIO)


def sequence_guard(probability: Column, sequence: Column, highest_risk: Column, block_at: float = 0.8) -> Column:
    """Whether a sequence is blocked: by its probability or its jumps, unless it is calm in both, when length alone has driven the score."""
    calm = (sequence < CALM_SEQUENCE) & (highest_risk < CALM_RISK)
    return ((probability >= block_at) | (sequence >= SEQUENCE_BLOCK)) & ~calm
