"""Operators over the steps of a session: windows, range joins and folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions import parsing, prefilter, rules, text


def by_session(step: str = "step") -> Window:
    return Window.partitionBy("session_id").orderBy(step)


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` above computed columns: pushed below them, the filter would copy and evaluate their expressions again."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")


def user_goal(df: DataFrame) -> DataFrame:
    """The session's first prompt so far, which later ones never replace."""
    first = F.first(F.when(F.col("action_type") == "prompt", F.col("action")), ignorenulls=True)
    return df.withColumn("goal", first.over(by_session().rowsBetween(Window.unboundedPreceding, 0)))


def with_resets(df: DataFrame, reset: Column, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scan`` of sessions whose state is dropped before each step that meets ``reset``; adds ``life``, the number of resets so far."""
    life = F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(by_session().rowsBetween(Window.unboundedPreceding, 0))
    lives = df.withColumn("life", life).withColumn("_session", F.col("session_id")).withColumn("session_id", F.concat_ws("#", "session_id", "life"))
    return scan(lives).withColumn("session_id", F.col("_session")).drop("_session")


def flag_state(df: DataFrame, ttl_steps: int = rules.FLAG_STEPS, ttl_seconds: int = rules.FLAG_SECONDS) -> DataFrame:
    """Adds ``active_flags``, seen at most so many steps and seconds ago, and ``expired_flags``, seen before but not within that.

    Needs ``flags`` (array), ``step`` and ``ts`` (seconds). One pass over the session for all flags.
    """
    alive = lambda seen: (F.col("step") - seen["step"] <= ttl_steps) & (F.col("ts") - seen["ts"] <= ttl_seconds)
    active, expired = [], []
    for flag in [*rules.FLAGS, "suspicious_target"]:
        at = F.when(F.array_contains("flags", flag), F.struct("step", "ts"))
        seen = lambda end, at=at: F.last(at, ignorenulls=True).over(by_session().rowsBetween(Window.unboundedPreceding, end))
        active.append(F.when(alive(seen(0)), F.lit(flag)))
        expired.append(F.when(~alive(seen(-1)), F.lit(flag)))
    return df.withColumn("active_flags", F.array_compact(F.array(*active))).withColumn("expired_flags", F.array_compact(F.array(*expired)))


def session_flags(df: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Flags of each action's scan form; an address that neither the user's goal nor a trusted tool's earlier output names is a suspicious target.

    Steps that were ``blocked`` before show no flag, but count as steps.
    """
    df = user_goal(df).withColumn("target", rules.exfil_target(F.col("action"), F.col("goal")))
    known = trusted_values(df)
    df = df.join(known, (F.col("session_id") == F.col("_ts")) & (F.col("target") == F.col("_tv")) & (F.col("step") > F.col("_first")), "left")
    df = df.withColumn("_envelope", parsing.envelope(F.col("action")))
    if "normal" in df.columns:  # the action's own form is known
        other = F.when(~F.col("_envelope").eqNullSafe(F.col("action")), F.col("_envelope"))
        df = df.withColumn("_form", F.when(other.isNull(), F.col("normal")).otherwise(text.pre_normalise(other)))
    else:
        df = df.withColumn("_form", text.pre_normalise(F.col("_envelope")))
    df = df.withColumn("flags", rules.extract_flags(F.col("_form"))).drop("_envelope")
    suspicious = F.col("target").isNotNull() & F.col("_tv").isNull()
    df = df.withColumn("flags", F.when(suspicious, F.array_append("flags", F.lit("suspicious_target"))).otherwise(F.col("flags"))).drop("_ts", "_tv", "_first", "_form")
    return df if blocked is None else df.withColumn("flags", F.when(blocked, F.array().cast("array<string>")).otherwise(F.col("flags")))


def trusted_values(df: DataFrame) -> DataFrame:
    """``_ts, _tv, _first``: the addresses and links that trusted tools gave in a session, and when first."""
    tokens = F.array_distinct(F.concat(F.regexp_extract_all("action", F.lit(prefilter.bounds(f"({rules.EMAIL})")), F.lit(1)), F.regexp_extract_all("action", F.lit(f"({rules.URL})"), F.lit(1))))
    tool = F.regexp_extract("action", r"^([A-Za-z_]\w*)\(", 1)
    given = df.where(tool.isin(*rules.TRUSTED_TOOLS)).select(F.col("session_id").alias("_ts"), "step", F.explode(tokens).alias("_tv"))
    return given.groupBy("_ts", "_tv").agg(F.min("step").alias("_first"))


def combo_scan(df: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Per step the riskiest combination of active flags that the step adds to."""
    df = flag_state(session_flags(df, blocked))
    return df.withColumn("hit", rules.combo_check(F.col("active_flags"), F.col("flags")))


def session_scan(df: DataFrame, blocked: Column | None = None) -> DataFrame:
    """The combination scan with its trigger counts: from the threshold on a step is blocked, before it is escalated.

    A combination's count starts anew when one of its flags has expired. A step that repeats the last finding says so.
    """
    hits = combo_scan(df, blocked)
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    resets = [F.sum(F.arrays_overlap("expired_flags", F.array(*map(F.lit, flags))).cast("int")).over(upto) for flags, *_ in rules.COMBOS]
    hits = hits.withColumn("_resets", F.array(*resets)).withColumn("_epoch", F.get("_resets", -F.col("hit.order")))
    count = F.row_number().over(Window.partitionBy("session_id", "hit.combo", "_epoch").orderBy("step"))
    hits = hits.withColumn("triggers", F.when(F.col("hit").isNotNull(), count).otherwise(F.lit(0)))
    risk = F.when((F.col("hit.risk") < 0.85) & (F.col("triggers") >= F.col("hit.threshold")), F.lit(0.85)).otherwise(F.col("hit.risk"))
    hits = hits.withColumn("risk", F.coalesce(risk, F.lit(0.0)))
    escalated = F.col("hit.risk") < F.col("risk")
    said = F.when(F.col("hit").isNotNull(), F.when(escalated, F.format_string("ESCALATED (Repeated %dx): %s", F.col("triggers"), F.col("hit.combo"))).otherwise(F.col("hit.combo")))
    hits = hits.withColumn("_said", said)
    before = F.last("_said", ignorenulls=True).over(by_session().rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_repeat", F.col("_said").eqNullSafe(before) & F.col("_said").isNotNull())
    decision = F.when(F.col("hit").isNull(), "ALLOW").when(F.col("risk") >= 0.85, "BLOCK").otherwise("MONITOR")
    if blocked is not None:
        decision = F.when(blocked, "BLOCK").otherwise(decision)
    rule = F.when(F.col("_repeat"), "cross_step_repeat").when(F.col("risk") >= 0.85, "cross_step_combo").when(F.col("hit").isNotNull(), "cross_step_suspicious")
    return hits.select("session_id", "step", "flags", "active_flags", F.col("hit.combo").alias("combo"), "triggers", decision.alias("decision"), rule.alias("rule"), "risk")


def action_chain(df: DataFrame, pre: Column, post: Column, window_seconds: int, name: str) -> DataFrame:
    """For each step that meets ``pre`` the first later step within the window that meets ``post``.

    Done with a range frame over the session, so no pair of steps is ever made.
    """
    ahead = Window.partitionBy("session_id").orderBy("ts").rangeBetween(1, window_seconds)
    df = df.select("session_id", "step", "ts", pre.alias("_pre"), F.when(post, F.struct("ts", "step")).alias("_post"))
    df = df.withColumn("_next", F.min("_post").over(ahead))
    return df.where(F.col("_pre") & F.col("_next").isNotNull()).select("session_id", F.lit(name).alias("rule"), F.col("step").alias("pre_step"), F.col("_next.step").alias("post_step"))


def taint_overlap(df: DataFrame, steps: int | None = None, seconds: int | None = None) -> DataFrame:
    """Steps whose text holds an address or link that a tool's output of an earlier step of the session gave.

    Without a lifetime the first such output is named, with one the last, if it is not older.
    """
    tokens = lambda c: F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(prefilter.bounds(f"({rules.EMAIL})")), F.lit(1)), F.regexp_extract_all(c, F.lit(f"({rules.URL})"), F.lit(1))))
    each = df.select("session_id", "step", "ts", "action_type", F.explode(tokens(F.col("action"))).alias("value"))
    if steps is None:
        first = each.where("action_type = 'tool_call'").groupBy("session_id", "value").agg(F.min("step").alias("from_step"))
        return each.join(first, ["session_id", "value"]).where("step > from_step").select("session_id", "step", "value", "from_step")
    before = Window.partitionBy("session_id", "value").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("action_type") == "tool_call", F.struct("step", "ts")), ignorenulls=True).over(before)
    out = each.withColumn("_last", last)
    return out.where((F.col("step") - F.col("_last.step") <= steps) & (F.col("ts") - F.col("_last.ts") <= seconds)).select("session_id", "step", "value", F.col("_last.step").alias("from_step"))


def cumulative_risk(df: DataFrame, risk: str = "risk", decay: float = 0.1, latch: float = 8.0, least: float = 0.5) -> DataFrame:
    """Exponentially decayed sum of risks of at least ``least``, as a window sum, and whether it ever reached the latch."""
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    hours = (F.col("ts") - F.min("ts").over(Window.partitionBy("session_id"))) / 3600.0
    df = df.withColumn("_h", hours)
    score = F.sum(F.when(F.col(risk) >= least, F.col(risk) * F.exp(decay * F.col("_h"))).otherwise(F.lit(0.0))).over(upto) * F.exp(-decay * F.col("_h"))
    df = df.withColumn("cumulative", score)
    return df.withColumn("quarantined", F.max(F.col("cumulative") >= latch).over(upto)).drop("_h")


def sequence_features(df: DataFrame, risk: Column | None = None) -> DataFrame:
    """Seven features a step, scaled: time since the step before, payload, risk, depth, fan-out (always 0), distinct tools, use of the resource."""
    w = by_session()
    tool = F.regexp_extract("action", r"^([A-Za-z_]\w*)\(", 1)
    resource = F.left(F.regexp_extract("action", r"""=\s*["']?([^"',)]+)""", 1), F.lit(120))
    df = df.withColumn("tool", tool).withColumn("resource", resource).withColumn("_risk", F.coalesce(risk if risk is not None else F.lit(0.0), F.lit(0.0)))
    first = (F.row_number().over(Window.partitionBy("session_id", "tool").orderBy("step")) == 1) & (F.col("tool") != "")
    df = df.withColumn("_first", first.cast("int"))
    scaled = lambda c, by: F.least(c / F.lit(by), F.lit(10.0))
    return df.select(
        "session_id", "step",
        scaled(F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(0)) * 1000, 10000.0).alias("iat"),
        scaled(F.length("action"), 10000.0).alias("payload"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_risk"))).alias("risk"),
        (F.least(F.row_number().over(w), F.lit(10)) / 10).alias("depth"),
        F.lit(0.0).alias("fanout"),
        (F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 10).alias("distinct_tools"),
        F.when(F.col("resource") != "", F.row_number().over(Window.partitionBy("session_id", "resource").orderBy("step")) / 10).otherwise(F.lit(0.0)).alias("resource_freq"),
    )


def decay_risk(df: DataFrame, risk: str, steps: int = 10, factor: float = 0.9) -> DataFrame:
    """Adds ``decayed``: the risks of the last steps, each as it is seen from the step, ``risk * factor ** distance``, oldest first."""
    near = F.collect_list(risk).over(by_session().rowsBetween(1 - steps, 0))
    df = df.withColumn("_near", near)
    return df.withColumn("decayed", F.transform("_near", lambda r, i: F.round(r * F.pow(F.lit(factor), F.size("_near") - 1 - i), 8))).drop("_near")


def sequence_risk(df: DataFrame, vector: str, by: str, order: str, steps: int = 3, gain: float = 1.2) -> DataFrame:
    """Adds ``seq_risk``: how far the last vectors of a sequence are from each other at most, neighbour by neighbour, times ``gain``, up to 1."""
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumn("_jump", F.greatest(F.lit(0.0), 1 - text.cosine(F.col(vector), F.lag(vector).over(w))))
    far = F.max("_jump").over(w.rowsBetween(2 - steps, 0))
    return df.withColumn("seq_risk", F.round(F.least(F.lit(1.0), gain * F.coalesce(far, F.lit(0.0))), 5)).drop("_jump")


def detector_tail(df: DataFrame) -> DataFrame:
    """The contiguous tool messages at the end of a session: no other kind follows them."""
    after = by_session().rowsBetween(1, Window.unboundedFollowing)
    others = F.count_if(F.col("action_type") != "tool_call").over(after)
    return df.withColumn("_later", others).where((F.col("_later") == 0) & (F.col("action_type") == "tool_call")).drop("_later")


def conversation_prefix(df: DataFrame) -> DataFrame:
    """Everything said up to a message, as ``role: text`` lines.

    The session's text is joined once and each message takes its head of it, so no list is built anew for each step.
    """
    line = F.concat_ws(": ", "role", "action")
    whole = df.groupBy(F.col("session_id").alias("_sid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda x: x["line"]), "\n").alias("_whole"))
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    ends = df.withColumn("_end", F.sum(F.length(line) + 1).over(upto) - 1)
    return ends.join(whole, F.col("session_id") == F.col("_sid")).withColumn("prefix", F.substr("_whole", F.lit(1), F.col("_end").cast("int"))).drop("_whole", "_end", "_sid")


def sliding_rate(df: DataFrame, flag: Column, rows: int = 100) -> DataFrame:
    return df.withColumn("rate", F.avg(flag.cast("int")).over(by_session().rowsBetween(1 - rows, 0)))
