"""Sinks that may see a micro-batch twice, and replays of a table as the batches in which its rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from emberlane.functions import rules


def batch_writer(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch goes to a folder named by its id, so one that is replayed replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").format(form).save(f"{path}/batch={number}")

    return write


def written_batches(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """What all batches wrote so far."""
    return spark.read.schema(schema).format(form).load(f"{path}/batch=*")


def feedback_sink(decisions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch's decisions, with every text redacted, as JSON lines under ``path/kept``.

    Decisions without an action say nothing and are not kept; how many those were is written beside each batch (:func:`dropped`).
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count_if(F.col("action").isNull()).alias("dropped"))
        texts = [c for c, kind in batch.dtypes if kind == "string"]
        rows = rows.where("action IS NOT NULL")
        for c in texts:
            rows = rules.redact(rows, c, c)
        batch_writer(f"{path}/kept", form="json")(rows, number)
        n = batch.sparkSession.createDataFrame([(seen.get["dropped"],)], "dropped long")
        batch_writer(f"{path}/dropped", form="json")(n, number)

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dropped(spark: SparkSession, path: str) -> int:
    """How many decisions a feedback sink has left out so far, over all batches and restarts."""
    counts = spark.read.schema("dropped long").json(f"{path}/dropped/batch=*")
    return counts.agg(F.sum("dropped")).first()[0] or 0


def within_watermark(events: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """Streaming rows without copies (by ``key``) and without those that come after the watermark has passed them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def replay(df: DataFrame, batch: str, run: Callable[[DataFrame], DataStreamWriter], folder: str) -> dict[str, int]:
    """Runs a streaming query over the rows of ``df`` as they arrive, batch by batch, stopped and started anew from its checkpoint in between.

    Returns how many rows came in, and how many the query's state operators dropped as too late.
    """
    spark = df.sparkSession
    df.write.partitionBy(batch).parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    numbers = sorted(r[0] for r in staged.select(batch).distinct().collect())  # a value a batch
    schema = df.drop(batch).schema
    total = {"input": 0, "late": 0}
    for number in numbers:
        staged.where(F.col(batch) == number).drop(batch).write.mode("append").parquet(f"{folder}/in")
        query = run(spark.readStream.schema(schema).parquet(f"{folder}/in")).trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            total["input"] += progress["numInputRows"]
            total["late"] += sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    return total
