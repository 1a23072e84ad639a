"""Loaders of public datasets that have been staged as tables: columns found by name, labels mapped, rows as action records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators.curation import rank_within
from emberlane.sources.dataset import read_dataset
from emberlane.sources.tables import infer_column


@dataclass(frozen=True)
class Spec:
    """How a dataset becomes action records."""

    name: str
    prefix: str
    text: tuple[str, ...] = ("text", "prompt", "action", "input")
    label: tuple[str, ...] = ("label", "is_injection", "class", "target")
    malicious: tuple[str, ...] = ("1", "malicious", "injection", "true")
    always: str | None = None
    per_group: tuple[tuple[str, ...], int] | None = None
    fallback: tuple[tuple[str, str], ...] = field(default=())


# --- fixed values -----------------------------------------------------------------------------------
NEURALCHEMY = Spec("neuralchemy", "neural")
PRODNULL = Spec("prodnull", "prod")
LLMAIL = Spec("llmail-inject", "llmail", text=("body",), always="malicious", per_group=(("scenario", "team_id"), 10))
#: Where the benchmark of indirect injections is staged, in the order in which copies are tried.
BIPIA_SOURCES = ("microsoft/BIPIA", "MAlmasabi/Indirect-Prompt-Injection-BIPIA-GPT", "wu981526092/BIPIA", "rubend18/ChatGPT-Jailbreak-Prompts")
BIPIA_ATTACK = ("attack", "injection", "injected")
BIPIA_CONTEXT = ("context", "document", "content")
BIPIA_TASK = ("task", "domain", "type")
# ----------------------------------------------------------------------------------------------------


def staged(spark: SparkSession, paths: tuple[str, ...], spec: Spec) -> DataFrame:
    """The first of the paths that is there, else the rows the dataset falls back on."""
    return read_dataset(spark, paths, fallback=[{"text": t, "label": b} for t, b in spec.fallback])


def _holding(df: DataFrame, parts: tuple[str, ...]) -> str | None:
    """The first column whose name holds one of the parts."""
    return next((c for c in df.columns if any(p in c.lower() for p in parts)), None)


def load_bipia(df: DataFrame, order: str) -> DataFrame:
    """Action records of a staged copy: every attack is malicious, and contexts are benign, half as many as the attacks (the first in drawn order).

    A copy without a column of attacks gives its first text column. Sessions are named by the task, if it has one, and ``order``.
    """
    attack, context, task = (_holding(df, parts) for parts in (BIPIA_ATTACK, BIPIA_CONTEXT, BIPIA_TASK))
    attack = attack or next(c for c, kind in df.dtypes if kind == "string")
    place = F.col(order).cast("string")
    filled = lambda c: F.coalesce(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "nan"), F.lit(False))

    def records(rows: DataFrame, column: str, label: str, kind: str, session: F.Column) -> DataFrame:
        return rows.select(F.col(f"`{column}`").alias("action"), F.lit(label).alias("label"), session.alias("session_id"), F.lit(kind).alias("attack_type"), F.lit(0).alias("step_index"), F.lit("bipia").alias("source_dataset"), F.lit(False).alias("augmented"))

    named = F.concat_ws("-", F.lit("bipia"), F.coalesce(F.col(f"`{task}`").cast("string"), F.lit("unknown")), place) if task else F.concat(F.lit("bipia-"), place)
    bad = records(df.where(filled(attack)), attack, "malicious", "malicious_single", named)
    if not context or context == attack:
        return bad
    half = bad.count() // 2
    drawn = rank_within(df.where(F.col(f"`{context}`").isNotNull()).withColumn("_all", F.lit(0)), ["_all"], [order]).where(F.col("rn") <= half)
    return bad.unionByName(records(drawn.where(filled(context)), context, "benign", "benign", F.concat(F.lit("bipia-benign-"), place)))


def load(df: DataFrame, spec: Spec, order: str) -> DataFrame:
    """Action records of a staged table; blank texts go, a group keeps so many rows drawn by hash, sessions are named by ``order``."""
    text = infer_column(df, spec.text)
    label = infer_column(df, spec.label)
    text = F.col(f"`{df.columns[0]}`") if text is None else text
    label = F.col(f"`{df.columns[-1]}`") if label is None else label
    if spec.per_group:
        from pyspark.sql import Window

        by, n = spec.per_group
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.col(order).cast("string")), order))
        df = df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    bad = F.lower(label.cast("string")).isin(*spec.malicious) if spec.always is None else F.lit(spec.always == "malicious")
    made = F.when(F.coalesce(bad, F.lit(False)), "malicious").otherwise("benign")
    return df.where(F.trim(text.cast("string")) != "").select(
        text.cast("string").alias("action"), made.alias("label"), F.concat(F.lit(spec.prefix + "-"), F.col(order).cast("string")).alias("session_id"),
        F.when(made == "malicious", "malicious_single").otherwise("benign").alias("attack_type"), F.lit(0).alias("step_index"), F.lit(spec.name).alias("source_dataset"), F.lit(False).alias("augmented"),
    )


def objectives(text: F.Column) -> F.Column:
    """``struct<exfil_success, defense_caught>`` of a JSON record of goals; broken or missing ones are neither."""
    flag = lambda name: F.coalesce(F.get_json_object(text, f"$['{name}']").cast("boolean"), F.lit(False))
    sent = flag("exfil.sent") & flag("exfil.destination") & flag("exfil.content")
    seen = F.get_json_object(text, "$['defense.undetected']").cast("boolean")
    parsed = F.get_json_object(text, "$").isNotNull()
    return F.struct((parsed & sent).alias("exfil_success"), (parsed & ~F.coalesce(seen, F.lit(True))).alias("defense_caught"))


def tool_calls(df: DataFrame, session: str, messages: str, least: int = 2) -> DataFrame:
    """``session_id, step_index, action`` from nested messages (role, content, calls of name and arguments); short sessions go.

    A tool's message is its content; any other gives its calls as ``name(arguments)``.
    """
    each = F.transform(messages, lambda m: F.when(m["role"] == "tool", F.array(m["content"])).otherwise(F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: F.concat(F.coalesce(c["name"], F.lit("unknown")), F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")")))))
    df = df.withColumn("_calls", F.flatten(each)).where(F.size("_calls") >= least)
    return df.select(F.col(session).alias("session_id"), F.posexplode("_calls").alias("step_index", "action"))
