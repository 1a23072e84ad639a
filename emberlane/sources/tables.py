"""Sources and sinks: Parquet, JSON lines, CSV, traces, staged hub datasets, and the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
ACTION_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("action", T.StringType()), ("label", T.StringType()), ("session_id", T.StringType()), ("attack_type", T.StringType()), ("step_index", T.IntegerType()), ("source_dataset", T.StringType()), ("augmented", T.BooleanType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once and read again, in ``folder`` or the one in ``spark.checkpoint.dir`` (a temporary one for a local master).

    Rounds that read each other's rows stay short this way, and a lost executor costs no earlier round.
    """
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/emberlane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one for a local master, and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local-") or not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="emberlane-"))


def parse_json_lines(lines: DataFrame, schema: T.StructType = ACTION_SCHEMA) -> DataFrame:
    """Records of a table of lines (``value``); blank and broken lines are skipped."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where(F.col("r._bad").isNull()).select("r.*").drop("_bad")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = ACTION_SCHEMA) -> DataFrame:
    return parse_json_lines(spark.read.text(path), schema)


def sink_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType = ACTION_SCHEMA) -> None:
    scan_jsonl(spark, source, schema).write.mode("overwrite").parquet(target)


def scan_csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a CSV file, trimmed, without empty values."""
    return spark.read.option("header", True).csv(path).select(F.trim(F.col(f"`{column}`")).alias(column)).where(F.length(column) > 0)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def infer_column(df: DataFrame, candidates: tuple[str, ...]) -> Column | None:
    """The first candidate that the frame has, whatever its case."""
    names = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{names[c]}`") for c in candidates if c in names), None)


def sink_traces(df: DataFrame, path: str) -> None:
    """Traces under pipeline / suite / attack, with the user and the injection task in the rows; a missing part is ``none``.

    Tasks are as many as sessions, so a folder for each would be a file for each; folders stay few however many traces there are.
    """
    keys = ["pipeline_name", "suite_name", "user_task_id", "attack_type", "injection_task_id"]
    out = df.select(*[F.coalesce(F.col(k), F.lit("none")).alias(k) for k in keys], *[c for c in df.columns if c not in keys])
    out.write.mode("overwrite").partitionBy("pipeline_name", "suite_name", "attack_type").json(path)


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces, with text contents of the older format as lists of content blocks."""
    rows = spark.read.json(path)
    return rows if dict(rows.dtypes).get("messages", "").find("content:array") >= 0 else upgrade_traces(rows)


def upgrade_traces(df: DataFrame) -> DataFrame:
    block = lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("content"))).alias("content"))
    return df.withColumn("messages", F.transform("messages", block))


def scan_suite(traces: DataFrame, suite: str, attacks_on_all: tuple[str, ...] = ("dos",)) -> DataFrame:
    """The traces of a suite; of an attack that is the same for every injection only the first injection task counts."""
    rows = traces.where(F.col("suite_name") == suite)
    same = F.col("attack_type").isin(*attacks_on_all)
    return rows.where(~same | (F.col("injection_task_id") == "injection_task_0"))
