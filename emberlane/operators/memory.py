"""What a session, or a user over several sessions, has gathered so far: unions of stages as running bit sets.

A union only grows, so between two changes it is constant: what a detector reports at the k-th step of such a stretch follows
from k, and no fold over the session is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions import stages
from emberlane.operators.sessions import by_session, kept


def _holds(bits: Column, need: tuple[str, ...], names: tuple[str, ...]) -> Column:
    mask = stages.bits_of(names, need)
    return bits.bitwiseAND(F.lit(mask)) == mask


def gathered(df: DataFrame, text: str, bits: Column) -> DataFrame:
    """Adds ``current`` (bits of the step), ``combined`` and ``previous`` (of all distinct actions up to, and before, the step)."""
    df = df.withColumn("current", bits)
    first = F.row_number().over(Window.partitionBy("session_id", F.md5(text)).orderBy("step")) == 1
    df = df.withColumn("_new", F.when(first, F.col("current")).otherwise(0))
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    before = by_session().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("combined", F.bit_or("_new").over(upto)).withColumn("previous", F.coalesce(F.bit_or("_new").over(before), F.lit(0))).drop("_new")


def multi_step_memory(df: DataFrame, text: str = "action") -> DataFrame:
    """``session_id, step, rule, severity, critical, confidence, previous, combined`` of every alert.

    The rules that the union meets alert one after the other, at the steps with a stage of their own, and anew once it has grown.
    """
    df = gathered(df, text, stages.memory_bits(F.col(text))).where("current > 0 OR previous > 0")
    turn = F.row_number().over(Window.partitionBy("session_id", "combined").orderBy("step"))
    df = df.where("current > 0").withColumn("_turn", turn)
    met = F.array_compact(F.array(*[F.when(_holds(F.col("combined"), need, stages.MEMORY_NAMES), F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("critical"), F.lit(p).alias("confidence"))) for k, (need, s, c, p) in enumerate(stages.MEMORY_RULES)]))
    df = df.withColumn("_hit", F.get(met, F.col("_turn") - 1)).where("_hit IS NOT NULL")
    return df.select("session_id", "step", "_hit.*", stages.stage_names(F.col("previous"), stages.MEMORY_NAMES).alias("previous"), stages.stage_names(F.col("combined"), stages.MEMORY_NAMES).alias("combined"))


def session_context(df: DataFrame, text: str = "action") -> DataFrame:
    """Per step the stages, ``n_chains`` and ``chain`` (how many combinations are new, and the worst), else ``accumulated`` severity, and ``block``.

    Combinations alert once for each union. Without one, the stages of the step count by themselves. A chain of 88 or more
    blocks, and so does a final stage after two risky ones.
    """
    names = stages.CONTEXT_NAMES
    df = gathered(df, text, stages.context_bits(F.col(text)))
    met = F.array_compact(F.array(*[F.when(_holds(F.col("combined"), need, names), F.lit(s)) for need, s in stages.CONTEXT_RULES]))
    df = df.withColumn("_met", met)
    fresh = F.row_number().over(Window.partitionBy("session_id", "combined").orderBy("step")) == 1
    df = df.withColumn("_fresh", fresh)
    chains = F.when(F.col("_fresh"), F.size("_met")).otherwise(0)
    chain = F.when(F.col("_fresh"), F.array_max("_met"))
    alone = F.array_max(F.array_compact(F.array(*[F.when(F.col("current").bitwiseAND(F.lit(1 << k)) != 0, F.lit(s)) for k, (_, _, s) in enumerate(stages.CONTEXT_STAGES)])))
    accumulated = F.when((F.size("_met") == 0) & (F.col("current") > 0), alone)
    prior, final = stages.bits_of(names, stages.HIGH_RISK_PRIOR), stages.bits_of(names, stages.FINAL_STAGES)
    staged = accumulated.isNotNull() & (F.bit_count(F.col("previous").bitwiseAND(F.lit(prior))) >= 2) & (F.col("current").bitwiseAND(F.lit(final)) != 0)
    return df.select(
        "session_id", "step", stages.stage_names(F.col("current"), names).alias("current"), stages.stage_names(F.col("combined"), names).alias("combined"),
        chains.cast("bigint").alias("n_chains"), chain.alias("chain"), accumulated.alias("accumulated"), (F.coalesce(chain >= 88, F.lit(False)) | staged).alias("block"),
    )


def global_threat(df: DataFrame, text: str = "action", rows: int = 200) -> DataFrame:
    """``user_id, session_id, step, rule, severity, critical``: where a user's last events, over two sessions or more, first meet a rule.

    An event is a step that shows a stage. At each event the first rule that holds counts; a user has each rule once.
    """
    names = ("sensitive_read", "external_send", "cover_tracks", "privileged_exec")
    events = df.withColumn("_all", stages.memory_bits(F.col(text)))
    bits = F.lit(0)
    for k, n in enumerate(names):
        bits = bits + F.when(F.col("_all").bitwiseAND(F.lit(1 << stages.MEMORY_NAMES.index(n))) != 0, 1 << k).otherwise(0)
    events = kept(events.withColumn("_bits", bits), F.col("_bits") > 0)
    last = Window.partitionBy("user_id").orderBy("ts", "session_id", "step").rowsBetween(1 - rows, 0)
    seen = events.withColumn("_union", F.bit_or("_bits").over(last)).withColumn("_many", F.min("session_id").over(last) != F.max("session_id").over(last))
    first = F.coalesce(*[F.when(_holds(F.col("_union"), need, names), F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("critical"))) for k, (need, s, c, _) in enumerate(stages.THREAT_RULES)])
    hits = seen.where("_many").withColumn("_hit", first).where("_hit IS NOT NULL")
    once = hits.groupBy("user_id", "_hit").agg(F.min_by(F.struct("session_id", "step"), F.struct("ts", "session_id", "step")).alias("at"))
    return once.select("user_id", "at.session_id", "at.step", "_hit.rule", "_hit.severity", "_hit.critical")


def semantic_taint(df: DataFrame, text: str = "action", threshold: float = 0.75, keep: int = 3) -> DataFrame:
    """``session_id, step, tainted, similarity, reason``: whether a step repeats what one of the last tool outputs said.

    Outputs are the session's tool steps of more than 10 characters before the step; the last ``keep`` of them count. A long text
    of high entropy that cannot be decoded is suspected at 0.6; else the text, decoded if it is encoded, is compared by trigrams.
    """
    from emberlane.functions import parsing
    from emberlane.functions import text as T

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: the texts are few bytes for the work that they make
    output = (F.col("action_type") == "tool_call") & (F.length(text) > 10)
    before = by_session().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_plain", parsing.try_decode(F.col(text))).withColumn("_out", F.when(output, F.struct(F.lower(text).alias("t")))).repartition(parts, "session_id")
    last = F.col("_out")
    for k in range(keep):  # the last output's last output is the last but one
        df = df.withColumn(f"_{k}", F.last(last, ignorenulls=True).over(before)["t"])
        last = F.when(F.col("_out").isNotNull(), F.struct(F.col(f"_{k}").alias("t")))
    given = F.array_compact(F.array(*[f"_{k}" for k in range(keep)]))
    # a step that is there twice has the greatest similarity of both; without a session or a step there is none
    sim = F.when(F.col("session_id").isNotNull() & F.col("step").isNotNull(), T.nearest(F.lower(F.coalesce("_plain", text)), given))
    blob = (F.length(text) > 100) & F.col("_plain").isNull() & (T.shannon_entropy(F.col(text)) > 5.5) & F.col("_0").isNotNull()
    out = df.select("session_id", "step", F.col("_plain").isNotNull().alias("_decoded"), blob.alias("_blob"), sim.alias("_own"))
    out = out.withColumn("_sim", F.max("_own").over(Window.partitionBy("session_id", "step")))
    sim = F.when(F.col("_blob"), F.lit(0.6)).otherwise(F.round(F.coalesce("_sim", F.lit(0.0)), 8))
    reason = F.when(F.col("_blob"), "high entropy").when(sim >= threshold, F.when(F.col("_decoded"), "match after decoding").otherwise("match")).otherwise("")
    return out.select("session_id", "step", (F.col("_blob") | (sim >= threshold)).alias("tainted"), sim.alias("similarity"), reason.alias("reason"))


def trusted_targets(df: DataFrame, text: str = "action") -> DataFrame:
    """``session_id, step, target``: the addresses and links of a step that no earlier output of a trusted tool has given."""
    from emberlane.functions import prefilter, rules

    tokens = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(prefilter.bounds(f"({rules.EMAIL})")), F.lit(1)), F.regexp_extract_all(text, F.lit(f"({rules.URL})"), F.lit(1))))
    each = df.select("session_id", "step", F.regexp_extract(text, r"^([A-Za-z_]\w*)\(", 1).alias("tool"), F.explode(tokens).alias("target"))
    trusted = each.where(F.col("tool").isin(*rules.TRUSTED_TOOLS)).groupBy(F.col("session_id").alias("_s"), F.col("target").alias("_t")).agg(F.min("step").alias("_first"))
    return each.join(trusted, (F.col("session_id") == F.col("_s")) & (F.col("target") == F.col("_t")) & (F.col("step") > F.col("_first")), "left_anti").select("session_id", "step", "target")
