"""Controllers whose state each decision changes, and near-duplicates that are kept first come.

What a controller sees (how many decisions, the rate of the last ones) and what it does (steps of a threshold within bounds, an
exponential mean, a small state machine) compose, so each is a parallel prefix over the order of decisions (:mod:`emberlane.operators.prefix`):
no task holds a controller's decisions, however few controllers there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.prefix import AFFINE, CLAMPED, machine, prefix, sums
from emberlane.operators.similar import similar, small_side
from emberlane.sources.tables import written

# --- fixed values -----------------------------------------------------------------------------------
START, LOW, HIGH = 0.72, 0.58, 0.95
UP, DOWN, WINDOW, EVERY, WARM_UP = 0.06, 0.03, 100, 10, 30
TARGET, TIGHTEN_ABOVE, LOOSEN_BELOW = 0.10, 1.2, 0.5
EMA_START, EMA_ALPHA, EMA_DOWN, EMA_WARM_UP, EMA_SESSIONS = 0.70, 0.02, 0.02, 200, 30
BUDGET_START, BUDGET_TARGET, BUDGET_HIGH = 0.70, 0.05, 0.92
# ----------------------------------------------------------------------------------------------------


def _side(rate: Column, target: float) -> Column:
    return F.when(rate > TIGHTEN_ABOVE * target, 1).when(rate < LOOSEN_BELOW * target, -1).otherwise(0)


def _numbered(df: DataFrame, key: str, order: str, flags: dict[str, Column]) -> DataFrame:
    """Decisions with ``seen``, their number within the key, and running counts of the flags; equal places are ordered by the other columns."""
    order_by = [F.col(order), *[F.col(c) for c in df.columns if c not in (key, order)]]
    counted = df.withColumns({"seen": F.lit(1), **{n: F.coalesce(c.cast("int"), F.lit(0)) for n, c in flags.items()}})
    out = prefix(counted, [key], order_by, sums("seen", *flags), "decisions")
    return written(out.withColumns({n: F.col(n).cast("long") for n in ("seen", *flags)}), "numbered")


def _step(side: Column, up: float, down: float, low: float, high: float) -> dict[str, Column]:
    """A move up or down that stays within bounds, as a step of a clamped value."""
    inf = F.lit(float("inf"))
    return {
        "a": F.when(side > 0, up).when(side < 0, -down).otherwise(0.0),
        "lo": F.when(side < 0, low).otherwise(-inf),
        "hi": F.when(side > 0, high).otherwise(inf),
    }


def _moved(start: float, a: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(F.lit(start) + a, lo), hi)


def _latest(numbered: DataFrame, checks: DataFrame, key: str, order: str, start: float) -> DataFrame:
    """Each decision with the threshold after it: that of the last check (``at``), of which each stands for ten decisions."""
    at = F.col("seen") - F.pmod(F.col("seen"), F.lit(EVERY))
    known = checks.select(F.col(key).alias("_k"), F.col("at").alias("_at"), "threshold")
    out = numbered.withColumn("_n", at).join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_at")), "left")
    return out.select(key, order, F.round(F.coalesce("threshold", F.lit(start)), 6).alias("threshold"))


def adaptive_threshold(df: DataFrame, key: str, order: str, blocked: str) -> DataFrame:
    """``key, order, threshold`` after each decision of a key.

    Every ten decisions the block rate of the last hundred is checked; the second check in a row on the same side moves the
    threshold and starts the count anew. Three states (nothing yet, one above, one below) and a clamped value make up the machine.
    """
    numbered = _numbered(df.select(key, order, blocked), key, order, {"hits": F.col(blocked)})
    tens = numbered.where(F.col("seen") % EVERY == 0).select(F.col(key).alias("_k"), F.col("seen").alias("at"), F.col("hits").alias("_now"))
    earlier = tens.select(F.col("_k").alias("_ek"), (F.col("at") + WINDOW).alias("_eat"), F.col("_now").alias("_then"))
    checks = tens.join(earlier, F.col("_k").eqNullSafe(F.col("_ek")) & (F.col("at") == F.col("_eat")), "left")
    rate = (F.col("_now") - F.coalesce("_then", F.lit(0))) / F.least(F.col("at"), F.lit(WINDOW))
    side = F.when(F.col("at") < WARM_UP, None).otherwise(_side(rate, TARGET))
    checks = checks.select(F.col("_k").alias(key), "at", side.alias("side"))
    # states: 0 nothing, 1 one check above, 2 one check below; before the warm-up nothing is checked
    step = _step(F.col("side"), UP, DOWN, LOW, HIGH)
    still = {"a": F.lit(0.0), "lo": F.lit(-float("inf")), "hi": F.lit(float("inf"))}
    columns = {}
    for state, turns in ((0, 0), (1, 1), (2, -1)):
        moves = F.coalesce(F.col("side") == turns, F.lit(False)) if turns else F.lit(False)
        follows = F.when(F.col("side").isNull(), state).when(moves | (F.col("side") == 0), 0).when(F.col("side") > 0, 1).otherwise(2)
        columns |= {f"to_{state}": follows.cast("double")} | {f"{k}_{state}": F.when(moves, step[k]).otherwise(still[k]) for k in still}
    walked = prefix(checks.withColumns(columns), [key], [F.col("at")], machine(3), "checks")
    return _latest(numbered, walked.withColumn("threshold", _moved(START, F.col("a_0"), F.col("lo_0"), F.col("hi_0"))), key, order, START)


def _walked(checks: DataFrame, key: str, start: float, *bounds: float) -> DataFrame:
    """Checks (``at, side``) with the threshold after each."""
    walked = prefix(checks.withColumns(_step(F.col("side"), *bounds)), [key], [F.col("at")], CLAMPED, "checks")
    return walked.withColumn("threshold", _moved(start, F.col("a"), F.col("lo"), F.col("hi")))


def fpr_budget(df: DataFrame, key: str, order: str, blocked: str, truth: str) -> DataFrame:
    """``key, order, threshold`` of a controller that knows the truth: every ten decisions the false positive rate so far is checked."""
    benign = F.col(truth) == 0
    numbered = _numbered(df.select(key, order, blocked, truth), key, order, {"fp": benign & F.col(blocked), "clean": benign})
    rate = F.when(F.col("clean") > 0, F.col("fp") / F.col("clean")).otherwise(F.lit(0.0))
    side = _side(rate, BUDGET_TARGET)
    checks = numbered.where(F.col("seen") % EVERY == 0).select(key, F.col("seen").alias("at"), F.when((side < 0) & (F.col("seen") < WARM_UP), 0).otherwise(side).alias("side"))
    return _latest(numbered, _walked(checks, key, BUDGET_START, UP, DOWN, LOW, BUDGET_HIGH), key, order, BUDGET_START)


def adaptive_threshold_ema(df: DataFrame, key: str, order: str, blocked: str, session: str) -> DataFrame:
    """``key, order, threshold`` by the exponential mean of decisions, checked every ten after 200 decisions and 30 sessions.

    A mean's step is affine in the mean before it; ten decisions are one step, so the prefix over steps sees a tenth of the rows.
    """
    a = EMA_ALPHA
    first = F.row_number().over(Window.partitionBy(key, session).orderBy(order)) == 1
    numbered = _numbered(df.select(key, order, blocked, first.cast("int").alias("_new")), key, order, {"sessions": F.col("_new")})
    block = F.ceil(F.col("seen") / EVERY).cast("long")
    weight = F.lit(a) * F.pow(F.lit(1 - a), F.pmod(-F.col("seen"), F.lit(EVERY)))
    blocks = numbered.groupBy(key, (block * EVERY).alias("at")).agg(F.sum(weight * F.col(blocked).cast("int")).alias("c"), F.max("sessions").alias("sessions"), F.count(F.lit(1)).alias("n")).where(F.col("n") == EVERY)
    means = prefix(blocks.withColumn("m", F.lit((1 - a) ** EVERY)), [key], [F.col("at")], AFFINE, "means")
    mean = F.col("m") * TARGET + F.col("c")
    side = F.when((F.col("at") >= EMA_WARM_UP) & (F.col("sessions") >= EMA_SESSIONS), _side(mean, TARGET)).otherwise(0)
    return _latest(numbered, _walked(means.select(key, "at", side.alias("side")), key, EMA_START, UP, EMA_DOWN, LOW, HIGH), key, order, EMA_START)


def _candidates(sets: DataFrame, threshold: float, folder: str | None = None) -> DataFrame:
    """Pairs ``first < id`` of similar word sets (``id, w``) with their ``similarity``."""
    return similar(sets, threshold, folder).withColumn("similarity", F.round("similarity", 8))


def _word_sets(df: DataFrame, key: str, text: str, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all rows ``id, w`` and the set's number (``k, h``); of each set its number and first id; and each set once (``id, w``).

    A row's set is written where the row is; sets are told apart by numbers of 96 bits, and only those travel.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.transform(words, lambda w: F.xxhash64(w))).alias("w"))
    sets = written(sets.select("id", "w", F.xxhash64("w").alias("k"), F.hash("w").alias("h")), "sets", folder)
    firsts = written(sets.groupBy("k", "h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts", folder)
    again = sets.select("id", "k", "h").join(firsts.where("n > 1").drop("n"), ["k", "h"]).where("not id <=> first").select("id", "k", "h").distinct()
    again = small_side(written(again, "again", folder))
    return sets, firsts, sets.join(again, ["id", "k", "h"], "left_anti").select("id", "w")


def nearest_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """``id, nearest, similarity``: the earlier row whose word set is most like this one's, if it is so like; of equals the first."""
    sets, firsts, single = _word_sets(df, key, text)
    pairs = _candidates(single, threshold)
    near = pairs.groupBy("id").agg(F.min_by(F.struct(F.col("first").alias("nearest"), "similarity"), F.struct(-F.col("similarity"), "first")).alias("n")).select("id", "n.*")
    same = sets.select("id", "k", "h").join(firsts.where("n > 1").select("k", "h", F.col("first").alias("nearest")), ["k", "h"])
    return near.unionByName(same.where("id <> nearest").select("id", "nearest", F.lit(1.0).alias("similarity")))


def minhash_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.85, folder: str | None = None) -> DataFrame:
    """The ids that stay: a row goes if an earlier one that stays shares so much of its word set (without words: is empty, too).

    Whether an earlier row stays is settled round by round: rows without an undecided earlier neighbour stay, and all their later
    neighbours go. Equal sets are one entry. Each round's rows are written to ``folder`` (the folder of checkpoints by default).
    """
    _, firsts, single = _word_sets(df, key, text, folder)
    live = written(_candidates(single, threshold, folder).select("first", "id"), "pairs", folder)
    gone = None
    while not live.isEmpty():
        stays = live.select("first").distinct().join(live.select(F.col("id").alias("first")), "first", "left_anti")
        goes = written(live.join(stays, "first", "left_semi").select("id").distinct(), "gone", folder)
        gone = goes if gone is None else gone.unionAll(goes)
        rest = live.join(goes, "id", "left_anti").join(goes.withColumnRenamed("id", "first"), "first", "left_anti")
        live = written(rest.select("first", "id"), "pairs", folder)
    ids = firsts.select(F.col("first").alias("id"))
    return ids if gone is None else ids.join(gone, "id", "left_anti")
